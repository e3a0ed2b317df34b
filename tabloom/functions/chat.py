"""Chat turns and chat templates.

When the turns of a conversation are known at plan time, the template is applied at plan time too and
the rendered text is one ``concat``. Stored message arrays of any length go through
:func:`render_messages`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions import fixed
from tabloom.functions.text import Part, has_text, or_literal, text


@dataclass(frozen=True)
class ChatTemplate:
    """Text around each turn; ``{role}`` in the prefix and suffix stands for the role name.

    The default marks are the public ChatML ones. ``variables`` are extra template settings (for
    example a reasoning effort) put into an opening system line by ``preamble``.
    """

    prefix: str = "<|im_start|>{role}\n"
    suffix: str = "<|im_end|>\n"
    generation_prefix: str = "<|im_start|>assistant\n"
    preamble: str = ""
    variables: Mapping[str, str] = field(default_factory=dict)

    def opening(self) -> str:
        return self.preamble.format(**self.variables)

    def before(self, role: str) -> str:
        return self.prefix.replace("{role}", role)

    def after(self, role: str) -> str:
        return self.suffix.replace("{role}", role)


CHATML = ChatTemplate()


@dataclass(frozen=True)
class Turn:
    role: str
    content: tuple[Part, ...]


def training_turns(problem: Column, solution: Column, null_as: str | None = None) -> list[Turn]:
    """System, problem and solution turns of a training example."""
    return [
        Turn("system", (fixed.TRAINING_SYSTEM,)),
        Turn("user", (fixed.PROBLEM_HEADING, or_literal(problem, null_as))),
        Turn("assistant", (fixed.SOLUTION_HEADING + "\n", or_literal(solution, null_as))),
    ]


def inference_turns(problem: Column, system_message: str | None = None, null_as: str | None = None) -> list[Turn]:
    """System and problem turns of a prompt that asks for a solution."""
    system = fixed.INFERENCE_SYSTEM if system_message is None else system_message
    asked = (fixed.PROBLEM_HEADING, or_literal(problem, null_as), "\n\n" + fixed.SOLUTION_HEADING)
    return [Turn("system", (system,)), Turn("user", asked)]


def instruction_turns(instruction: Column, input_text: Column, output: Column) -> list[Turn]:
    """An instruction row as a conversation; the input is a second line only when there is one."""
    asked = F.when(has_text(input_text), text(instruction, "\n", input_text)).otherwise(instruction)
    return [
        Turn("system", (fixed.ASSISTANT_SYSTEM,)),
        Turn("user", (asked,)),
        Turn("assistant", (output,)),
    ]


def messages(turns: Sequence[Turn]) -> Column:
    """The turns as an ``array<struct<role, content>>`` value."""
    return F.array(
        *[F.struct(F.lit(t.role).alias("role"), text(*t.content).alias("content")) for t in turns]
    )


def render(turns: Sequence[Turn], template: ChatTemplate = CHATML, generation: bool = False) -> Column:
    """Chat text of turns known at plan time, optionally ending where the answer should begin."""
    parts: list[Part] = [template.opening()]
    for turn in turns:
        parts += [template.before(turn.role), *turn.content, template.after(turn.role)]
    if generation:
        parts.append(template.generation_prefix)
    return text(*parts)


def render_turn(role: Column, content: Column, template: ChatTemplate = CHATML) -> Column:
    """One turn whose role is data."""

    def with_role(pattern: str) -> list[Part]:
        pieces = pattern.split("{role}")
        parts: list[Part] = [pieces[0]]
        for piece in pieces[1:]:
            parts += [role, piece]
        return parts

    return text(*with_role(template.prefix), content, *with_role(template.suffix))


def render_messages(column: Column, template: ChatTemplate = CHATML, generation: bool = False) -> Column:
    """Chat text of a stored message array."""
    turns = F.array_join(F.transform(column, lambda m: render_turn(m["role"], m["content"], template)), "")
    return text(template.opening(), turns, template.generation_prefix if generation else "")
