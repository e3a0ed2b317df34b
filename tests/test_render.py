"""Exact bytes of rendered texts."""

import pytest
from pyspark.sql import functions as F

from tabloom.functions import chat, fixed, prompts
from tabloom.functions.text import filled, has_text, text

INSTRUCTION = "instruction string, input string, output string"


@pytest.mark.parametrize(
    "given, block", [("", ""), (None, ""), (" ", "### Input:\n \n"), ("ctx", "### Input:\nctx\n")]
)
def test_instruction_training_text(one, given, block):
    expression = prompts.instruction_training_text(F.col("instruction"), F.col("input"), F.col("output"))
    made = one(expression, INSTRUCTION, instruction="do", input=given, output="done")
    assert made == f"### Instruction:\ndo\n{block}### Response:\ndone\n<|endoftext|>"


def test_missing_instruction_is_null_or_replaced(one):
    columns = F.col("instruction"), F.col("input"), F.col("output")
    values = {"instruction": None, "input": "", "output": "o"}
    assert one(prompts.instruction_training_text(*columns), INSTRUCTION, **values) is None
    replaced = one(prompts.instruction_training_text(*columns, null_as="nan"), INSTRUCTION, **values)
    assert replaced == "### Instruction:\nnan\n### Response:\no\n<|endoftext|>"


def test_training_chat(one):
    turns = chat.training_turns(F.lit("1+1?"), F.lit("2"))
    assert one(chat.render(turns)) == (
        "<|im_start|>system\nSolve mathematical problems with logically complete and formally justified solutions:<|im_end|>\n"
        "<|im_start|>user\n### Problem:\n1+1?<|im_end|>\n<|im_start|>assistant\n### Solution:\n2<|im_end|>\n"
    )
    assert [tuple(m) for m in one(chat.messages(turns))] == [
        ("system", fixed.TRAINING_SYSTEM), ("user", "### Problem:\n1+1?"), ("assistant", "### Solution:\n2"),
    ]


def test_stored_messages_render_like_turns(one):
    turns = chat.inference_turns(F.lit("p"))
    direct = one(chat.render(turns, generation=True))
    assert one(chat.render_messages(chat.messages(turns), generation=True)) == direct
    assert direct.endswith("### Problem:\np\n\n### Solution:<|im_end|>\n<|im_start|>assistant\n")
    assert fixed.INFERENCE_SYSTEM in direct and fixed.TRAINING_SYSTEM not in direct


def test_system_message_and_template_are_replaceable(one):
    template = chat.ChatTemplate("[{role}]", "[/{role}]", "[bot]", "effort={effort};", {"effort": "high"})
    turns = chat.inference_turns(F.lit("p"), system_message="S")
    assert one(chat.render(turns, template, generation=True)) == (
        "effort=high;[system]S[/system][user]### Problem:\np\n\n### Solution:[/user][bot]"
    )
    assert one(chat.render_messages(chat.messages(turns), template)).startswith("effort=high;[system]S[/system]")


@pytest.mark.parametrize("given, user", [("ctx", "do\nctx"), ("", "do"), (None, "do")])
def test_instruction_chat(one, given, user):
    turns = chat.instruction_turns(F.col("instruction"), F.col("input"), F.col("output"))
    made = one(chat.messages(turns), INSTRUCTION, instruction="do", input=given, output="done")
    assert [tuple(m) for m in made] == [("system", "You are a helpful assistant."), ("user", user), ("assistant", "done")]


def test_instruction_prompt_keeps_an_empty_input(one):
    preamble = (
        "Below is an instruction that describes a task, paired with an input that provides further context. "
        "Write a response that appropriately completes the request."
    )
    assert one(prompts.instruction_prompt(F.lit("do"))) == (
        preamble + "\n\n### Instruction:\ndo\n\n### Input:\n\n\n### Response:\n"
    )
    assert one(prompts.instruction_prompt(F.lit("do"), F.lit("x"), indent=4)) == (
        preamble + "\n\n    ### Instruction:\n    do\n\n    ### Input:\n    x\n\n    ### Response:\n    "
    )


def test_plain_prompt(one):
    assert one(prompts.plain_problem_prompt(F.lit("p"))) == fixed.INFERENCE_SYSTEM + "\n\n### Problem:\np\n\n### Solution:"
    assert one(prompts.plain_problem_prompt(F.lit("p"), "S")) == "S\n\n### Problem:\np\n\n### Solution:"


def test_judge_prompt(one):
    made = one(prompts.judge_prompt(F.lit('say "x"\nthen'), F.lit("first"), F.lit("second"), indent=4))
    assert made == (
        "\n    You are an expert in evaluating the solutions of math problems with respect to their logical completeness "
        "and formally justified solutions\n"
        "    Compare these two solutions to the same problem and provide scoring.\n"
        '\n    ### Problem:\n    say "x"\nthen\n'
        "\n    ### 1st Solution:\n    first\n"
        "\n    ### 2nd Solution:\n    second\n"
        "\n    Evaluate both solutions on:\n    1. Correctness (is the answer right?)\n"
        "    2. Clarity and explanation quality\n    3. Mathematical rigor\n    4. Completeness\n"
        "\n    Give the Final answer in this exact JSON format:\n    \n    {\n"
        '        "problem": "say "x"\nthen",\n        "first_score": 5,\n        "second_score": 5\n    }\n'
        "\n    Replace the numbers with the actual values.\n    "
    )
    escaped = one(prompts.judge_prompt(F.lit('say "x"\nthen'), F.lit("a"), F.lit("b"), escape=True))
    assert '"problem": "say \\"x\\"\\nthen",\n' in escaped


def test_neighbouring_literals_are_folded(spark):
    plan = spark.range(1).select(text("a", "b", F.col("id").cast("string"), "c", "", "d"))._jdf.queryExecution().toString()
    assert "concat(ab, " in plan and ", cd)" in plan


def test_template_slots(one):
    assert one(filled("{}-%s-{}", F.lit("{}"), "b")) == "{}-%s-b"
    with pytest.raises(ValueError):
        filled("{}", "a", "b")


def test_has_text(one):
    assert [one(has_text(F.col("s")), "s string", s=s) for s in ("", None, " ", "x")] == [False, False, True, True]
