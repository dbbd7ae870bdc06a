"""The text functions for SQL users, as Spark SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusloom.functions.prompts import TEST_PLAIN, TRAIN_PLAIN
from corpusloom.functions.text import EOS, INST_CLOSE, INST_OPEN
from corpusloom.operators.splitting import OVERLAP, WINDOW


def _filled(template: str) -> str:
    """SQL expression for a prompt template with ``{name}`` slots."""
    out = []
    for part in template.replace("}", "{").split("{"):
        out.append(part if part in ("instruction", "input", "output") else "'" + part.replace("\n", "\\n") + "'")
    return "concat(" + ", ".join(out) + ")"


_STRIP = r"regexp_replace({x}, r'(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z', '')"
_LAST = f"substring_index(decoded, '{INST_OPEN}', -1)"
_ANSWER = _STRIP.format(x=f"split_part({_LAST}, '{INST_CLOSE}', 2)")
_STRIDE = WINDOW - OVERLAP

SCALARS = {
    "train_prompt(instruction STRING, input STRING, output STRING) RETURNS STRING": _filled(TRAIN_PLAIN),
    "test_prompt(instruction STRING, input STRING) RETURNS STRING": _filled(TEST_PLAIN),
    "strip_text(x STRING) RETURNS STRING": _STRIP.format(x="x"),
    "text_words(x STRING) RETURNS ARRAY<STRING>": r"filter(split(x, r'\s+'), w -> w <> '')",
    "extract_response(decoded STRING) RETURNS STRING":
        f"CASE WHEN contains({_LAST}, '{INST_CLOSE}') THEN " + _STRIP.format(x=f"replace({_ANSWER}, '{EOS}', '')") + " END",
    # Explode its result in an outer query; the tokens are made once per row.
    "window_units(x STRING) RETURNS ARRAY<STRING>":
        r"get(transform(array(filter(split(x, r'\s+'), w -> w <> '')), t -> filter(transform(sequence(0, "
        f"greatest(0, CAST(ceil((size(t) - {WINDOW}) / {_STRIDE}) AS INT))), "
        f"k -> array_join(slice(t, k * {_STRIDE} + 1, {WINDOW}), ' ')), c -> c <> '')), 0)",
}


def register(spark: SparkSession) -> None:
    """Create the temporary functions in the session."""
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
