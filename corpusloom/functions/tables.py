"""Splitting as a SQL table function, for texts that come in pieces (lines, pages) or whole."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from corpusloom.operators.splitting import OVERLAP, WINDOW

Tokenizer = Callable[[str], list[str]]


def blank_words(text: str) -> list[str]:
    """The words of ``functions.text.words``: between blanks of ASCII."""
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]


def window_function(tokenize: Tokenizer = blank_words, join: Callable[[list[str]], str] = " ".join) -> type:
    """The class behind the table function; ``tokenize`` is called a piece at a time, its tokens may hold blanks.

    All rows of one key are one document, in the order of their positions. Its windows are given out as they fill, so a task holds one
    window and one piece, however long the document is. Null pieces count as empty; a document without tokens has no rows. Rows of
    one document at the same position are read in the order of their texts, and those without a key are one document.
    """

    class Windows:
        def __init__(self) -> None:
            self.key, self.tokens, self.number, self.size, self.stride = None, [], 0, WINDOW, WINDOW - OVERLAP

        @staticmethod
        def analyze(
            rows: AnalyzeArgument, key: AnalyzeArgument, position: AnalyzeArgument, text: AnalyzeArgument,
            size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None,
        ) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table: TABLE(name)")
            kinds = {f.name: f.dataType for f in rows.dataType.fields}
            names = [key.value, position.value, text.value]
            if missing := [n for n in names if n not in kinds]:
                raise ValueError(f"no column {', '.join(map(str, missing))} in the table")
            n, back = size.value if size else WINDOW, overlap.value if overlap else OVERLAP
            if not 0 <= back < n:
                raise ValueError("the overlap must be smaller than the size")
            quoted = ["`" + name.replace("`", "``") + "`" for name in names]
            schema = StructType().add(key.value, kinds[key.value]).add("chunk_no", IntegerType()).add("chunk", StringType())
            return AnalyzeResult(
                schema.add("n_tokens", IntegerType()), partitionBy=[PartitioningColumn(quoted[0])],
                orderBy=[OrderingColumn(name) for name in quoted[1:]], select=[SelectedColumn(q) for q in dict.fromkeys(quoted)],
            )

        def eval(self, row: Row, key: str, position: str, text: str, size: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple]:
            self.key, self.size, self.stride = row[key], size, size - overlap
            if row[text] is None:
                return
            self.tokens += tokenize(row[text])
            at = 0
            while len(self.tokens) - at > size:
                yield self._window(at)
                at += self.stride
            del self.tokens[:at]

        def terminate(self) -> Iterator[tuple]:
            if self.tokens:
                yield self._window(0)

        def _window(self, at: int) -> tuple:
            part = self.tokens[at:at + self.size]
            self.number += 1
            return self.key, self.number - 1, join(part), len(part)

    return Windows


def register_tables(spark: SparkSession, name: str = "chunk_table", tokenize: Tokenizer = blank_words, join=" ".join) -> None:
    """Make the table function known to SQL: ``SELECT * FROM chunk_table(TABLE(lines), 'doc_id', 'line_no', 'text')``.

    Two more arguments set size and overlap in tokens. The function itself asks for the partitioning by key, the order by position
    and the columns it reads, so a caller needs neither ``PARTITION BY`` nor a projection.
    """
    spark.udtf.register(name, udtf(window_function(tokenize, join)))
