"""What a user supplies: generators and judges, plus deterministic ones for trials."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol, runtime_checkable


@dataclass(frozen=True)
class Completion:
    """An answer; the times of its first and last part after the prompt was taken up, and how many parts it came in, if known."""

    text: str
    first_token_us: int | None = None
    last_token_us: int | None = None
    parts: int | None = None


@runtime_checkable
class Generator(Protocol):
    """A model. ``open`` runs once per task before the first prompt."""

    def open(self) -> None: ...

    def generate(self, prompts: Sequence[str]) -> Sequence[Completion]: ...


@runtime_checkable
class Judge(Protocol):
    """A scorer. Returns one response text per prompt."""

    def open(self) -> None: ...

    def judge(self, prompts: Sequence[str]) -> Sequence[str]: ...


@runtime_checkable
class PartStream(Protocol):
    """A model that yields its answer part by part."""

    def open(self) -> None: ...

    def stream(self, prompt: str) -> Iterable[str]: ...


class Streamed:
    """A generator over a :class:`PartStream` that notes when the first and the last part came, in microseconds of ``clock``."""

    def __init__(self, make: Callable[[], PartStream], clock: Callable[[], int] | None = None):
        self._source = make()
        # A source that keeps its own time, such as a trial, is asked for it.
        self._clock = clock or getattr(self._source, "clock", None) or (lambda: time.perf_counter_ns() // 1000)

    def open(self) -> None:
        self._source.open()

    def generate(self, prompts: Sequence[str]) -> Sequence[Completion]:
        answers = []
        for prompt in prompts:
            start, first, last, parts = self._clock(), None, None, []
            for part in self._source.stream(prompt):
                last = self._clock() - start
                first = last if first is None else first
                parts.append(part)
            answers.append(Completion("".join(parts), first, last, len(parts)))
        return answers


class RateLimit:
    """Spaces calls so that one task stays below its share of the allowed rate.

    ``lead`` delays the first call, so that tasks that start together do not call together; :meth:`finish` waits until the next
    call would be due, so that a task that follows in the same place keeps the distance.
    """

    def __init__(
        self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
        lead: float = 0.0,
    ):
        self._gap = 1.0 / per_second
        self._clock = clock
        self._sleep = sleep
        self._next = clock() + lead

    def wait(self) -> None:
        now = self._clock()
        if now < self._next:
            self._sleep(self._next - now)
        self._next = max(now, self._next) + self._gap

    def finish(self) -> None:
        left = self._next - self._clock()
        if left > 0:
            self._sleep(left)


_PROBLEM = re.compile(r"### Problem:\n(.*)\n\n### Solution:", re.DOTALL)
_SOLUTIONS = re.compile(r"### 1st Solution:\n(.*)\n\n *### 2nd Solution:\n(.*)\n\n *Evaluate both solutions on:", re.DOTALL)
_WORD = re.compile(r"[^ \n]+")


class LeadingWords:
    """Answers with the first words of the prompt's problem, for trials without a model."""

    def __init__(self, words: int):
        self.words = words

    def open(self) -> None:
        pass

    def generate(self, prompts: Sequence[str]) -> Sequence[Completion]:
        answers = []
        for prompt in prompts:
            found = _PROBLEM.search(prompt)
            problem = found[1] if found else prompt
            answers.append(Completion(" ".join(_WORD.findall(problem)[: self.words]), first_token_us=0))
        return answers


class WordCountJudge:
    """Scores each solution by its number of words, at most ten, for trials without a judge."""

    def open(self) -> None:
        pass

    def judge(self, prompts: Sequence[str]) -> Sequence[str]:
        responses = []
        for prompt in prompts:
            first, second = _SOLUTIONS.search(prompt).groups()
            scores = [min(10, len(_WORD.findall(s))) for s in (first, second)]
            responses.append(json.dumps({"first_score": scores[0], "second_score": scores[1]}))
        return responses


class EchoingWords(LeadingWords):
    """The trial generator as an engine that repeats the prompt before its answer."""

    def generate(self, prompts: Sequence[str]) -> Sequence[Completion]:
        return [Completion(p + c.text) for p, c in zip(prompts, super().generate(prompts))]


class NeverAnswers:
    """A generator and judge whose every call fails."""

    def open(self) -> None:
        pass

    def generate(self, prompts: Sequence[str]) -> Sequence[Completion]:
        raise RuntimeError("no answer")

    def judge(self, prompts: Sequence[str]) -> Sequence[str]:
        raise RuntimeError("no answer")


class FailingAtFirst(LeadingWords):
    """The trial generator of an attempt, counted from 1: prompts answer from the attempt their length asks for, up to the third."""

    def __init__(self, words: int, attempt: int):
        super().__init__(words)
        self.attempt = attempt

    def generate(self, prompts: Sequence[str]) -> Sequence[Completion]:
        if any(len(p) % 3 >= self.attempt for p in prompts):
            raise RuntimeError("not yet")
        return super().generate(prompts)


class TimedWords(LeadingWords):
    """The trial generator word by word, on a clock of its own: a millisecond to begin, then ten microseconds per character."""

    def __init__(self, words: int):
        super().__init__(words)
        self._now = 0

    def clock(self) -> int:
        return self._now

    def stream(self, prompt: str) -> Iterator[str]:
        self._now += 1_000
        for at, word in enumerate(_WORD.findall(self.generate([prompt])[0].text)):
            self._now += 10 * len(word)
            yield (" " if at else "") + word


class ConstantJudge:
    """Gives every pair the same scores, for trials of how calls are sent."""

    def open(self) -> None:
        pass

    def judge(self, prompts: Sequence[str]) -> Sequence[str]:
        return ['{"first_score": 1, "second_score": 1}'] * len(prompts)
