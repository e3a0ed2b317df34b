"""Training texts and prompts that need no chat template."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions import fixed
from tabloom.functions.text import Part, filled, has_text, or_literal, text, with_margin


def instruction_training_text(
    instruction: Column, input_text: Column, output: Column, null_as: str | None = None
) -> Column:
    """Instruction, optional input and response sections, closed by the end marker."""
    block = F.when(has_text(input_text), text(fixed.INPUT_HEADING, input_text, "\n")).otherwise("")
    return text(
        fixed.INSTRUCTION_HEADING, or_literal(instruction, null_as), "\n", block,
        fixed.RESPONSE_HEADING, or_literal(output, null_as), "\n" + fixed.END_OF_TEXT,
    )


def instruction_prompt(instruction: Column, input_text: Part = "", indent: int = 0) -> Column:
    """Prompt with an always present input section and an empty response slot."""
    return filled(with_margin(fixed.INSTRUCTION_PROMPT, 0, indent), instruction, input_text, "")


def plain_problem_prompt(problem: Column, system_message: str | None = None) -> Column:
    """Problem prompt for engines that take plain text."""
    system = fixed.INFERENCE_SYSTEM if system_message is None else system_message
    return text(system + "\n\n" + fixed.PROBLEM_HEADING, problem, "\n\n" + fixed.SOLUTION_HEADING)


def judge_prompt(problem: Column, first: Column, second: Column, indent: int = 8, escape: bool = False) -> Column:
    """Pairwise rubric with a JSON answer skeleton.

    The problem is spliced into the skeleton as it is, so quotes and line breaks in it make the shown
    JSON invalid; ``escape`` writes it as a proper JSON string instead.
    """
    if escape:
        encoded = F.to_json(F.struct(problem.alias("problem")))
        quoted = F.substring(encoded, F.lit(12), F.length(encoded) - 12)
    else:
        quoted = text('"', problem, '"')
    return filled(with_margin(fixed.JUDGE_PROMPT, fixed.JUDGE_MARGIN, indent), problem, first, second, quoted)
