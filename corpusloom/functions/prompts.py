"""Task templates and prompt formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task instructions and prompt formats. Indents are part of the text.
SUMMARIZE = "Summarize the following text:"
ANSWER = "Answer the following question based on the text:"
QUESTION = "What is the main point discussed? be clear, concise, and structured."
EXTRACT = "Extract the main key points and takeaways from the following text:"
TRAIN_PLAIN = "<s>[INST] {instruction}\n{input} [/INST]\n{output} </s>"
TEST_PLAIN = "<s>[INST] {instruction}\n{input} [/INST]"
TRAIN_SYSTEM = "<s>[INST]<<SYS>> {system} <</SYS>>\n    {instruction}\n    {input} [/INST]\n    {output} </s>"
TEST_SYSTEM = "<s>[INST]<<SYS>> {system} <</SYS>>\n    {instruction}\n    {input} [/INST]"
COMPLETION = "\n  <s>[INST] {instruction}\n  {input} [/INST]\n  "

#: (template_id, task, instruction, output until one is generated); callers may pass their own list.
TASK_TEMPLATES = (
    (0, "summarization", SUMMARIZE, ""),
    (1, "question_answering", f"{ANSWER} {QUESTION}", ""),
    (2, "information_extraction", EXTRACT, ""),
)


def fill(template: str, **fields: Column) -> Column:
    """Put columns into the ``{name}`` slots of a template."""
    parts: list[Column] = []
    rest = template
    while rest:
        text, brace, tail = rest.partition("{")
        if text:
            parts.append(F.lit(text))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(fields[name])
    return F.concat(*parts)


def train_prompt(instruction: Column, input_: Column, output: Column, system: str | None = None) -> Column:
    if system is None:
        return fill(TRAIN_PLAIN, instruction=instruction, input=input_, output=output)
    return fill(TRAIN_SYSTEM, system=F.lit(system), instruction=instruction, input=input_, output=output)


def test_prompt(instruction: Column, input_: Column, system: str | None = None) -> Column:
    if system is None:
        return fill(TEST_PLAIN, instruction=instruction, input=input_)
    return fill(TEST_SYSTEM, system=F.lit(system), instruction=instruction, input=input_)


test_prompt.__test__ = False


def completion_prompt(instruction: Column, input_: Column) -> Column:
    """Completion form; its outer whitespace is kept."""
    return fill(COMPLETION, instruction=instruction, input=input_)


def request_text(instruction: Column, input_: Column) -> Column:
    """Text of the user message that asks for one output."""
    return F.concat(instruction, F.lit(" "), input_)
