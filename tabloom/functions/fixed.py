"""Texts, markers and settings that results must reproduce byte for byte."""

# Chat system texts. Training and inference wording differ on purpose.
TRAINING_SYSTEM = "Solve mathematical problems with logically complete and formally justified solutions:"
INFERENCE_SYSTEM = "Solve the following problem with logically complete and formally justified solutions:"
ASSISTANT_SYSTEM = "You are a helpful assistant."

# Section headings.
PROBLEM_HEADING = "### Problem:\n"
SOLUTION_HEADING = "### Solution:"
INSTRUCTION_HEADING = "### Instruction:\n"
INPUT_HEADING = "### Input:\n"
RESPONSE_HEADING = "### Response:\n"

# Markers.
END_OF_TEXT = "<|endoftext|>"
STOP_SEQUENCES = ("<|end_of_text|>", "</s>")

INSTRUCTION_PREAMBLE = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request."
)

INSTRUCTION_PROMPT = INSTRUCTION_PREAMBLE + """

### Instruction:
{}

### Input:
{}

### Response:
{}"""

# The judge's prompt at its own margin of eight; another margin is set by ``text.with_margin``.
JUDGE_MARGIN = 8
JUDGE_PROMPT = """
        You are an expert in evaluating the solutions of math problems with respect to their logical completeness and formally justified solutions
        Compare these two solutions to the same problem and provide scoring.

        ### Problem:
        {}

        ### 1st Solution:
        {}

        ### 2nd Solution:
        {}

        Evaluate both solutions on:
        1. Correctness (is the answer right?)
        2. Clarity and explanation quality
        3. Mathematical rigor
        4. Completeness

        Give the Final answer in this exact JSON format:
       \x20
        {
            "problem": {},
            "first_score": 5,
            "second_score": 5
        }

        Replace the numbers with the actual values.
        """

# Texts a CSV reader of the data-frame kind takes as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Numeric settings.
MAX_STEPS = 30
MAX_LENGTH = 512
PAD_MULTIPLE = 8
IGNORED_LABEL = -100
SEED = 108
HEAD_ROWS = 10_000
CALIBRATION_ROWS = 1_000
MAX_NEW_TOKENS = 128
