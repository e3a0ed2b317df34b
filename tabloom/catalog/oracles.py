"""The registered queries restated in plain SQL over the same tables."""

from __future__ import annotations

from tabloom.catalog.subword_sql import subword_ids

ORACLES: dict[str, str] = {}
# Fixed values, spelled here too so that the product's own texts are checked.
TRAINING_SYSTEM = "Solve mathematical problems with logically complete and formally justified solutions:"
INFERENCE_SYSTEM = "Solve the following problem with logically complete and formally justified solutions:"
PREAMBLE = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request."
)


def lit(text: str) -> str:
    """A text as an SQL literal; line breaks are spelled out."""
    pieces = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(pieces) + ")"


PAIRS = """
SELECT u.conv_id, u.turn, u.text AS "Problem", a.text AS "Solution"
FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""
INSTRUCTIONS = """
SELECT u.conv_id, u.turn, u.text AS instruction, coalesce(s.text, '') AS input, a.text AS output
FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.role = 'system'
WHERE u.role = 'user'
"""
RESPONSES = """
SELECT event_id AS example_id,
  CASE WHEN user_id % 2 = 0 THEN 'standard_inference' ELSE 'vllm_inference' END AS evaluation_type,
  CASE event_id % 13 WHEN 0 THEN 'not json' WHEN 1 THEN '{"first_score": 4}' WHEN 2 THEN NULL WHEN 3 THEN '[1]'
    WHEN 4 THEN replace(sound, '"', chr(39)) WHEN 5 THEN sound || ' done' WHEN 6 THEN sound || sound ELSE sound END AS raw
FROM (
  SELECT *, '{"problem": "p' || event_id || '", "first_score": ' || (1 + event_id % 10) || ', "second_score": '
    || (1 + user_id % 10) || '}' AS sound
  FROM events
)
"""
SCORED = f"""
SELECT example_id, evaluation_type, raw, coalesce(ok AND first IS NOT NULL AND second IS NOT NULL, false) AS valid,
  first, second
FROM (
  SELECT *, json_valid(raw) AS ok,
    CASE WHEN json_valid(raw) THEN TRY_CAST(json_extract_string(raw, '$.first_score') AS DOUBLE) END AS first,
    CASE WHEN json_valid(raw) THEN TRY_CAST(json_extract_string(raw, '$.second_score') AS DOUBLE) END AS second
  FROM ({RESPONSES})
)
"""
TIMINGS = """
SELECT event_id AS example_id, event_type AS engine, CAST(round(value * 1000) AS BIGINT) AS latency_us,
  CAST(ts AS TIMESTAMP) AS started_at
FROM events
"""
TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


def words(column: str, n: int) -> str:
    return f"array_to_string(list_slice(regexp_extract_all({column}, '[^ \\n]+'), 1, {n}), ' ')"


def chatml(role: str, content: str) -> str:
    return f"{lit(f'<|im_start|>{role}' + chr(10))} || {content} || {lit('<|im_end|>' + chr(10))}"


MATH_TEXT = " || ".join(
    [
        chatml("system", lit(TRAINING_SYSTEM)),
        chatml("user", lit("### Problem:\n") + ' || "Problem"'),
        chatml("assistant", lit("### Solution:\n") + ' || "Solution"'),
    ]
)
MATH_PROMPT = " || ".join(
    [
        chatml("system", lit(INFERENCE_SYSTEM)),
        chatml("user", lit("### Problem:\n") + ' || "Problem" || ' + lit("\n\n### Solution:")),
        lit("<|im_start|>assistant\n"),
    ]
)
INSTRUCTION_TEXT = (
    f"{lit('### Instruction:' + chr(10))} || instruction || chr(10) || "
    f"CASE WHEN input <> '' THEN {lit('### Input:' + chr(10))} || input || chr(10) ELSE '' END || "
    f"{lit('### Response:' + chr(10))} || output || {lit(chr(10) + '<|endoftext|>')}"
)

ORACLES["render_instruction_training"] = f"SELECT conv_id, turn, {INSTRUCTION_TEXT} AS text FROM ({INSTRUCTIONS})"
ORACLES["batched_map"] = f"""
SELECT conv_id, turn, instruction, length(instruction) + length(input) + length(output) AS characters FROM ({INSTRUCTIONS})
"""
ORACLES["render_chat_training"] = f"SELECT conv_id, turn, {MATH_TEXT} AS text FROM ({PAIRS})"
ORACLES["render_conversation"] = f"""
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || {lit('<|im_end|>' + chr(10))}, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
"""
_TRIMMED = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"
_OPENED = f"""CASE WHEN first THEN coalesce('<<SYS>>' || chr(10) || head || chr(10) || '<</SYS>>' || chr(10) || chr(10), '') ELSE '' END || text"""
ORACLES["render_compiled"] = f"""
WITH placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
    first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' AS opened
  FROM conversations
),
told AS (
  SELECT *, n = CASE WHEN opened THEN 2 ELSE 1 END AS first,
    CASE WHEN opened THEN first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS head
  FROM placed
),
rendered AS (
  SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chatml,
    string_agg(CASE WHEN opened AND n = 1 THEN '' WHEN role = 'user' THEN '<s>[INST] ' || {_TRIMMED % _OPENED} || ' [/INST]'
      WHEN role = 'assistant' THEN ' ' || {_TRIMMED % _OPENED} || ' </s>' ELSE '' END, '' ORDER BY turn) AS bracketed,
    string_agg('<|start|>' || CASE role WHEN 'system' THEN 'developer' ELSE role END || '<|message|>' || text || '<|end|>', '' ORDER BY turn) AS turns
  FROM told GROUP BY conv_id
)
SELECT conv_id, chatml, chatml || '<|im_start|>assistant' || chr(10) AS chatml_prompt, bracketed,
  '<|start|>system<|message|>Reasoning: high<|end|>' || turns || '<|start|>assistant' AS effortful_prompt
FROM rendered
"""
HELD_OUT = 'SELECT item_id AS example_id, text AS "Problem" FROM benchmark'
ORACLES["render_math_prompt"] = f"SELECT example_id, {MATH_PROMPT} AS prompt FROM ({HELD_OUT})"
ORACLES["render_math_prompt_plain"] = f"""
SELECT example_id, {lit(INFERENCE_SYSTEM + chr(10) + chr(10) + '### Problem:' + chr(10))} || "Problem"
  || {lit(chr(10) + chr(10) + '### Solution:')} AS prompt
FROM ({HELD_OUT})
"""
ORACLES["render_instruction_prompt"] = f"""
SELECT conv_id, turn,
  {lit(PREAMBLE)} || {lit(chr(10) * 2 + '### Instruction:' + chr(10))} || instruction
  || {lit(chr(10) * 2 + '### Input:' + chr(10))} || input || {lit(chr(10) * 2 + '### Response:' + chr(10))} AS prompt
FROM ({INSTRUCTIONS})
"""
ORACLES["render_instruction_chat"] = f"""
SELECT conv_id, turn,
  {chatml('system', lit('You are a helpful assistant.'))}
  || {chatml('user', "CASE WHEN input <> '' THEN instruction || chr(10) || input ELSE instruction END")}
  || {chatml('assistant', 'output')} AS text
FROM ({INSTRUCTIONS})
"""
_PAD = " " * 8
_JUDGE_OPENING = lit(
    f"\n{_PAD}You are an expert in evaluating the solutions of math problems with respect to their logical completeness "
    f"and formally justified solutions\n{_PAD}Compare these two solutions to the same problem and provide scoring.\n"
    f"\n{_PAD}### Problem:\n{_PAD}"
)
_JUDGE_RUBRIC = lit(
    f"\n\n{_PAD}Evaluate both solutions on:\n{_PAD}1. Correctness (is the answer right?)\n"
    f"{_PAD}2. Clarity and explanation quality\n{_PAD}3. Mathematical rigor\n{_PAD}4. Completeness\n"
    f'\n{_PAD}Give the Final answer in this exact JSON format:\n{_PAD}\n{_PAD}{{\n{_PAD}    "problem": "'
)
_JUDGE_END = lit(
    f'",\n{_PAD}    "first_score": 5,\n{_PAD}    "second_score": 5\n{_PAD}}}\n'
    f"\n{_PAD}Replace the numbers with the actual values.\n{_PAD}"
)
ORACLES["render_judge_prompt"] = f"""
SELECT conv_id, turn, {_JUDGE_OPENING} || "Problem" || {lit(f'{chr(10) * 2}{_PAD}### 1st Solution:{chr(10)}{_PAD}')}
  || {words('"Problem"', 32)} || {lit(f'{chr(10) * 2}{_PAD}### 2nd Solution:{chr(10)}{_PAD}')} || {words('"Problem"', 16)}
  || {_JUDGE_RUBRIC} || "Problem" || {_JUDGE_END} AS prompt
FROM ({PAIRS})
"""
ORACLES["typed_training_text"] = f"""
SELECT 'math' AS kind, conv_id, turn, {MATH_TEXT} AS text FROM ({PAIRS})
UNION ALL
SELECT 'alpaca', conv_id, turn, {INSTRUCTION_TEXT} FROM ({INSTRUCTIONS})
"""

ORACLES["head_split"] = f"SELECT * FROM ({PAIRS}) ORDER BY conv_id, turn LIMIT 100"
ORACLES["instruction_scan_split"] = f"""
SELECT conv_id, turn, instruction AS asked, output FROM ({INSTRUCTIONS})
WHERE conv_id % 10 <> 9 ORDER BY conv_id, turn LIMIT 1000
"""
ORACLES["too_long_prompts"] = f"""
SELECT doc_id AS example_id, len({TOKENS}) AS tokens FROM documents WHERE len({TOKENS}) > 512
"""
ORACLES["dataset_shape"] = "SELECT count(*) AS row_count, CAST(5 AS BIGINT) AS column_count FROM documents"

ORACLES["stop_cut"] = """
SELECT doc_id AS example_id,
  CASE WHEN p IS NULL THEN text ELSE substr(text, 1, p - 1) END AS text
FROM (SELECT *, least(nullif(strpos(text, chr(10)), 0), nullif(strpos(text, '. '), 0)) AS p FROM documents)
"""
ORACLES["strip_echo"] = f'SELECT conv_id, turn, "Solution" AS completion FROM ({PAIRS})'
ORACLES["zip_columns"] = """
WITH lists AS (
  SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) FILTER (WHERE turn % 7 <> 6) AS texts
  FROM conversations GROUP BY conv_id
), counted AS (
  SELECT *, least(len(roles), len(texts)) AS n FROM lists WHERE texts IS NOT NULL
)
SELECT conv_id, i - 1 AS position, roles[i] AS role, texts[i] AS text
FROM (SELECT conv_id, roles, texts, unnest(range(1, n + 1)) AS i FROM counted)
"""
ORACLES["result_access"] = "SELECT conv_id, turn, [{'outputs': [{'text': text}]}][1].outputs[1].text AS text FROM conversations"
ORACLES["json_encode"] = """
SELECT conv_id, turn, CAST(to_json({'role': role, 'text': text}) AS VARCHAR) AS json FROM conversations
"""
ORACLES["timestamps"] = f"""
SELECT example_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, least(latency_us, 20000) AS latency_us
FROM ({TIMINGS})
"""
ORACLES["elapsed"] = f"""
SELECT engine, epoch_us(max(started_at)) - epoch_us(min(started_at)) AS elapsed_us,
  coalesce(avg(latency_us) FILTER (WHERE latency_us > 10000), 0.0) AS mean_slow_us
FROM ({TIMINGS}) GROUP BY engine
"""


def vocabulary(source: str, tokens: str = TOKENS, reserved: int = 2) -> str:
    return f"""
SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + {reserved} AS id
FROM (SELECT token, count(*) AS n FROM (SELECT unnest({tokens}) AS token FROM {source}) GROUP BY token)
"""


DOC_VOCAB = vocabulary("documents")
ORACLES["vocab"] = DOC_VOCAB
ORACLES["vocab_whole"] = DOC_VOCAB
ORACLES["vocab_frequent"] = f"{DOC_VOCAB} ORDER BY n DESC, token LIMIT 1000"


def encoded(key: str, source: str, vocab: str, limit: int | None = None, tokens: str = TOKENS) -> str:
    """Id lists of ``source (key.., text)``, cut to ``limit`` tokens if there is one."""
    tokens = tokens if limit is None else f"list_slice({tokens}, 1, {limit})"
    return f"""
WITH vocab AS MATERIALIZED ({vocab}),
source AS MATERIALIZED (SELECT {key}, text, {tokens} AS toks FROM {source}),
exploded AS (SELECT {key}, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos FROM source),
found AS (
  SELECT {key}, list(coalesce(id, 0) ORDER BY pos) AS ids
  FROM exploded LEFT JOIN vocab USING (token) GROUP BY {key}
),
encoded AS (SELECT {key}, text, toks, coalesce(ids, []) AS ids FROM source LEFT JOIN found USING ({key}))
"""


DOCS = "(SELECT doc_id AS example_id, text FROM documents)"
DOC_IDS = encoded("example_id", DOCS, DOC_VOCAB)
DOC_IDS_512 = encoded("example_id", DOCS, DOC_VOCAB, 512)


def fill(value: str, n: str) -> str:
    """A list of ``n`` times ``value``."""
    return f"list_transform(range(CAST(greatest(0, {n}) AS BIGINT)), lambda x: {value})"


ORACLES["encode"] = DOC_IDS + "SELECT example_id, array_to_string(ids, ' ') AS input_ids FROM encoded"
ORACLES["encode_whole"] = DOC_IDS + """
SELECT example_id, len(ids) AS length, array_to_string(ids, ' ') AS input_ids FROM encoded
"""


ORACLES["decode"] = DOC_IDS + """
SELECT example_id, array_to_string(toks, ' ') AS text FROM source
"""
ORACLES["decoded_clean"] = ORACLES["decode"]
ORACLES["generated_capped"] = DOC_IDS + """
SELECT example_id, array_to_string(list_slice(ids, 1, 128), ' ') AS input_ids FROM encoded
"""
ORACLES["truncate_pad_mask"] = DOC_IDS_512 + f"""
SELECT example_id, array_to_string(list_concat(ids, {fill('2', '512 - len(ids)')}), ' ') AS input_ids,
  array_to_string(list_concat({fill('1', 'len(ids)')}, {fill('0', '512 - len(ids)')}), ' ') AS attention_mask
FROM encoded
"""
ORACLES["labels_masked"] = DOC_IDS + f"""
SELECT example_id, array_to_string(list_concat([1], ids, {fill('-100', 'greatest(511 - len(ids), 1)')}), ' ') AS labels
FROM encoded
"""
_ALPACA = f"(SELECT conv_id, turn, {INSTRUCTION_TEXT} AS text FROM ({INSTRUCTIONS}))"
_ALPACA_HEAD = f"(SELECT * FROM {_ALPACA} ORDER BY conv_id, turn LIMIT 1000)"
_MATH = f"(SELECT conv_id, turn, {MATH_TEXT} AS text FROM ({PAIRS}))"
ORACLES["calibration_sample"] = encoded("conv_id, turn", _ALPACA_HEAD, vocabulary(_ALPACA), 510) + f"""
SELECT conv_id, turn, text, array_to_string(list_concat([1], ids, [2]), ' ') AS input_ids,
  array_to_string({fill('1', 'len(ids) + 2')}, ' ') AS attention_mask
FROM encoded
"""
ORACLES["prepared_training_rows"] = encoded("conv_id, turn", _MATH, vocabulary(_MATH), 512) + f"""
SELECT conv_id, turn, text, array_to_string(list_concat(ids, {fill('2', '512 - len(ids)')}), ' ') AS input_ids,
  array_to_string(list_concat({fill('1', 'len(ids)')}, {fill('0', '512 - len(ids)')}), ' ') AS attention_mask
FROM encoded
"""
ORACLES["prepared_instruction_rows"] = encoded("conv_id, turn", _ALPACA, vocabulary(_ALPACA), 512) + f"""
SELECT conv_id, turn, array_to_string(list_concat(ids, {fill('2', '512 - len(ids)')}), ' ') AS input_ids,
  array_to_string(list_concat({fill('1', 'len(ids)')}, {fill('0', '512 - len(ids)')}), ' ') AS attention_mask
FROM encoded
"""
ORACLES["pad_longest_in_batch"] = DOC_IDS + f""",
batched AS (SELECT *, (row_number() OVER (ORDER BY example_id) - 1) // 8 AS batch_id FROM encoded),
sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM batched)
SELECT example_id, batch_id, longest,
  array_to_string(list_concat(ids, {fill('2', 'longest - len(ids)')}), ' ') AS input_ids,
  array_to_string(list_concat({fill('1', 'len(ids)')}, {fill('0', 'longest - len(ids)')}), ' ') AS attention_mask
FROM sized
"""
SCHEDULED = f"""
WITH sized AS (SELECT doc_id AS example_id, len({TOKENS}) AS length FROM documents),
placed AS (
  SELECT example_id, epoch, length, count(*) OVER (PARTITION BY epoch) AS total,
    row_number() OVER (PARTITION BY epoch ORDER BY md5('108:' || epoch || ':' || example_id), example_id) - 1 AS position
  FROM sized, (SELECT unnest(range(2)) AS epoch)
),
batched AS (SELECT *, position // 2 AS micro_batch FROM placed),
stepped AS (
  SELECT *, epoch * CAST(ceil(total / 8) AS BIGINT) + micro_batch // 4 AS step,
    max(length) OVER (PARTITION BY epoch, micro_batch) AS longest
  FROM batched
)
SELECT example_id, epoch, position, micro_batch, step, CAST(ceil(longest / 8) * 8 AS BIGINT) AS width
FROM stepped
"""
ORACLES["training_batches"] = SCHEDULED
ORACLES["training_steps_capped"] = f"{SCHEDULED} WHERE step < 30"
_MARKED_TOKENS = r"regexp_extract_all(text, '<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"
_MARKS = "('<|endoftext|>', '<|im_start|>', '<|im_end|>')"
_TYPED = f"({ORACLES['typed_training_text']})"
_MARKED_VOCAB = f"""
SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 5 AS id
FROM (
  SELECT token, count(*) AS n FROM (SELECT unnest({_MARKED_TOKENS}) AS token FROM {_TYPED})
  WHERE token NOT IN {_MARKS} GROUP BY token
)
UNION ALL VALUES ('<|endoftext|>', 0, 3), ('<|im_start|>', 0, 4), ('<|im_end|>', 0, 5)
"""
ORACLES["encode_marked"] = encoded("kind, conv_id, turn", _TYPED, _MARKED_VOCAB, tokens=_MARKED_TOKENS) + """
SELECT kind, conv_id, turn, array_to_string(ids, ' ') AS input_ids, CAST(ids[-1] AS BIGINT) AS last,
  array_to_string(toks, ' ') AS text
FROM encoded
"""
ORACLES["collated_batches"] = DOC_IDS + f""",
placed AS (
  SELECT *, (row_number() OVER (ORDER BY md5('108:0:' || example_id), example_id) - 1) // 2 AS micro_batch FROM encoded
),
sized AS (
  SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY micro_batch) / 8) * 8 AS BIGINT) AS width FROM placed
)
SELECT example_id, micro_batch, micro_batch // 4 AS step,
  array_to_string(list_concat(ids, {fill('2', 'width - len(ids)')}), ' ') AS input_ids,
  len(ids) AS attended,
  array_to_string(list_concat(ids, {fill('-100', 'width - len(ids)')}), ' ') AS labels
FROM sized
"""

ORACLES["decode_exact"] = "SELECT doc_id AS example_id, text FROM documents"
ORACLES["subword_decode"] = "SELECT doc_id AS example_id, text FROM documents"
_DOC_SUBWORDS = subword_ids("SELECT doc_id AS example_id, text FROM documents", "example_id")
ORACLES["subword_encode"] = _DOC_SUBWORDS + """
SELECT example_id, CAST(len(ids) AS BIGINT) AS length, array_to_string(ids, ' ') AS input_ids FROM subword_rows
"""
ORACLES["subword_vocab"] = _DOC_SUBWORDS + """
SELECT id, token, n FROM (SELECT id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM subword_rows) GROUP BY id) JOIN ranks USING (id)
"""
ORACLES["subword_training_rows"] = subword_ids(_MATH, "conv_id, turn") + f"""
SELECT conv_id, turn, text, array_to_string(list_concat(ids[:512], {fill('50256', '512 - len(ids)')}), ' ') AS input_ids,
  array_to_string(list_concat({fill('1', 'least(len(ids), 512)')}, {fill('0', '512 - len(ids)')}), ' ') AS attention_mask
FROM subword_rows
"""
ORACLES["subword_batches"] = subword_ids(_ALPACA, "conv_id, turn") + """,
placed AS (
  SELECT ids[:512] AS ids, (row_number() OVER (ORDER BY md5('108:0:' || conv_id || ':' || turn), conv_id, turn) - 1) // 2 AS micro_batch
  FROM subword_rows
)
SELECT CAST(0 AS BIGINT) AS epoch, micro_batch, count(*) AS row_count, CAST(ceil(max(len(ids)) / 8) * 8 AS BIGINT) AS width,
  CAST(sum(len(ids)) AS BIGINT) AS kept, CAST(sum(list_sum(ids)) AS BIGINT) AS label_sum
FROM placed GROUP BY micro_batch
"""

_TUNED, _BASE = words('"Problem"', 32), words('"Problem"', 16)
ORACLES["generate_stub"] = f"""
SELECT conv_id, turn, "Problem" AS problem, "Solution" AS original_solution, {_TUNED} AS generated_solution,
  'standard_inference' AS engine, CAST(NULL AS VARCHAR) AS error
FROM ({PAIRS})
"""
ORACLES["generation_roundtrip"] = f"""
SELECT "Problem" AS problem, "Solution" AS original_solution, {_TUNED} AS generated_solution FROM ({PAIRS})
"""
ORACLES["csv_problems"] = f"""
SELECT "Problem", CASE WHEN conv_id % 5 = 0 THEN NULL ELSE "Solution" END AS "Solution",
  CAST(CASE WHEN conv_id % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS complete
FROM ({PAIRS})
"""
ORACLES["csv_problems_split"] = f"""
SELECT conv_id, turn, '"Quoted", she said,' || chr(10) || chr(10) || '"' || "Problem" || '"' || chr(10) AS "Problem", "Solution"
FROM ({PAIRS})
"""
ORACLES["json_array_split"] = "SELECT doc_id AS example_id, text FROM documents"
ORACLES["experiment_log_split"] = f"""
SELECT evaluation_type, count(*) AS responses, count(*) AS total_comparisons, count(raw) AS answered,
  CAST(sum(length(raw)) AS BIGINT) AS characters, max(raw) AS last
FROM ({RESPONSES}) GROUP BY evaluation_type
"""
_PLAIN = f"""{lit(INFERENCE_SYSTEM + chr(10) + chr(10) + '### Problem:' + chr(10))} || "Problem" || {lit(chr(10) + chr(10) + '### Solution:')}"""
ORACLES["calls_resumed"] = f"""
SELECT conv_id, turn, CASE WHEN length({_PLAIN}) % 3 < 2 THEN {_BASE} END AS generated_solution,
  CASE WHEN length({_PLAIN}) % 3 = 2 THEN 'RuntimeError: not yet' END AS error
FROM ({PAIRS})
"""
ORACLES["judge_paced"] = "SELECT count(*) AS calls, CAST(0 AS BIGINT) AS exceeded FROM benchmark"
ORACLES["first_token_latency"] = f"""
WITH said AS (
  SELECT CASE WHEN length("Problem") % 2 = 0 THEN 'brief' ELSE 'long' END AS engine,
    list_slice(regexp_extract_all("Problem", '[^ \\n]+'), 1, CASE WHEN length("Problem") % 2 = 0 THEN 8 ELSE 32 END) AS words
  FROM ({PAIRS})
)
SELECT engine, count(*) AS samples, sum(1000 + 10 * length(words[1])) / count(*) AS mean_first_token_us,
  sum(10 * (length(array_to_string(words, '')) - length(words[1]))) / sum(len(words) - 1) AS mean_between_us
FROM said GROUP BY engine
"""
ORACLES["pair_outputs"] = f"""
SELECT conv_id, turn, "Problem" AS problem, {_TUNED} AS generated_solution, {_BASE} AS base_solution FROM ({PAIRS})
"""


def capped_words(column: str, n: int) -> str:
    return f"CAST(least(10, {n}, len(regexp_extract_all({column}, '[^ \\n]+'))) AS DOUBLE)"


ORACLES["judge_stub"] = f"""
SELECT conv_id, turn, {capped_words('"Problem"', 32)} AS first_score, {capped_words('"Problem"', 16)} AS second_score,
  CAST(NULL AS VARCHAR) AS error
FROM ({PAIRS})
"""
ORACLES["judge_disabled"] = f"""
SELECT 'base_output' AS kind, conv_id, turn, {_BASE} AS base_solution FROM ({PAIRS})
"""
ORACLES["evaluate_engine"] = f"""
SELECT coalesce(avg({capped_words('"Problem"', 32)}), 0.0) AS finetuned_avg,
  coalesce(avg({capped_words('"Problem"', 16)}), 0.0) AS base_avg, count(*) AS total_comparisons, count(*) AS all_comparisons
FROM ({PAIRS})
"""
ORACLES["engines_side_by_side"] = f"""
SELECT example_id // 20 AS batch_id,
  sum(CASE WHEN valid AND evaluation_type = 'standard_inference' THEN first END) AS standard_inference_first,
  sum(CASE WHEN valid AND evaluation_type = 'standard_inference' THEN second END) AS standard_inference_second,
  sum(CASE WHEN valid AND evaluation_type = 'vllm_inference' THEN first END) AS vllm_inference_first,
  sum(CASE WHEN valid AND evaluation_type = 'vllm_inference' THEN second END) AS vllm_inference_second
FROM ({SCORED}) GROUP BY 1
"""

ORACLES["score_parse"] = f"""
SELECT example_id, evaluation_type, first AS first_score, second AS second_score FROM ({SCORED}) WHERE valid
"""
ORACLES["score_rejects"] = f"SELECT example_id, evaluation_type, raw FROM ({SCORED}) WHERE NOT valid"
SUMMARY = """
coalesce(avg(CASE WHEN valid THEN first END), 0.0) AS finetuned_avg,
coalesce(avg(CASE WHEN valid THEN second END), 0.0) AS base_avg,
count(*) FILTER (WHERE valid) AS total_comparisons, count(*) AS all_comparisons
"""
ORACLES["score_summary"] = f"SELECT {SUMMARY} FROM ({SCORED})"
ORACLES["score_by_engine"] = f"SELECT evaluation_type, {SUMMARY} FROM ({SCORED}) GROUP BY evaluation_type"
ORACLES["score_strict"] = f"""
SELECT evaluation_type, {SUMMARY}
FROM (SELECT evaluation_type, first, second, valid AND example_id % 5 <> 0 AS valid FROM ({SCORED}))
GROUP BY evaluation_type
"""
ORACLES["score_stream"] = ORACLES["score_by_engine"]
ORACLES["score_stream_replaced"] = f"""
WITH scored AS ({SCORED}),
final AS (
  SELECT s.evaluation_type,
    CASE WHEN n.example_id IS NULL THEN s.valid ELSE n.valid END AS valid,
    CASE WHEN n.example_id IS NULL THEN s.first ELSE n.first END AS first,
    CASE WHEN n.example_id IS NULL THEN s.second ELSE n.second END AS second
  FROM scored s LEFT JOIN scored n ON n.example_id = s.example_id + 1 AND s.example_id % 3 = 0
)
SELECT 'run-' || evaluation_type AS experiment_id, evaluation_type, {SUMMARY} FROM final GROUP BY evaluation_type
"""
ORACLES["run_status"] = """
SELECT run_id,
  CASE WHEN NOT coalesce(bool_and(ok) FILTER (WHERE step <> 'vllm_evaluation'), true) THEN 'failed'
    WHEN NOT coalesce(bool_and(ok) FILTER (WHERE step = 'vllm_evaluation'), true) THEN 'partial_success'
    ELSE 'success' END AS status,
  count(*) AS steps
FROM (
  SELECT user_id AS run_id, event_id % 97 <> 0 AS ok,
    CASE event_id % 4 WHEN 0 THEN 'training' WHEN 1 THEN 'inference' WHEN 2 THEN 'standard_evaluation'
      ELSE 'vllm_evaluation' END AS step
  FROM events
) GROUP BY run_id
"""
ORACLES["latency_by_engine"] = f"""
SELECT engine, CAST(sum(latency_us) AS BIGINT) AS total_us, sum(latency_us) / count(latency_us) AS mean_us, min(latency_us) AS min_us,
  max(latency_us) AS max_us, count(latency_us) AS samples, round_even(sum(latency_us) / 1000000.0, 3) AS total_seconds
FROM ({TIMINGS}) GROUP BY engine
"""

ORACLES["config_resolved"] = """
SELECT event_id AS example_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'k' END AS unknown,
  CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') WHEN user_id % 3 = 0 THEN '64' ELSE '128' END AS max_new_tokens,
  CASE WHEN user_id % 3 = 0 THEN '0.0' ELSE '1.0' END AS temperature, 'False' AS do_sample
FROM events
"""
ORACLES["experiment_log_history"] = f"""
SELECT evaluation_type, CAST(2 AS BIGINT) AS entries, CAST(2 AS BIGINT) AS experiments, 2 * count(*) AS responses,
  2 * count(*) AS total_comparisons
FROM ({RESPONSES}) GROUP BY evaluation_type
"""

ORACLES["log_concurrent"] = f"""
SELECT 'e-' || evaluation_type AS experiment_id, evaluation_type, count(*) AS responses, count(*) AS total_comparisons,
  CAST(sum(example_id) AS BIGINT) AS id_sum, max(raw) AS last
FROM ({RESPONSES}) WHERE evaluation_type = 'vllm_inference' OR example_id % 3 = 0 GROUP BY evaluation_type
"""


def record(scored: str) -> str:
    """The flattened run record over ``engine, first, second, valid``."""
    columns = []
    for engine in ("standard_inference", "vllm_inference"):
        own = f"WHERE valid AND engine = '{engine}'"
        columns += [
            f"coalesce(avg(first) FILTER ({own}), 0.0) AS {engine}_finetuned_avg_score",
            f"coalesce(avg(second) FILTER ({own}), 0.0) AS {engine}_base_avg_score",
            f"count(*) FILTER ({own}) AS {engine}_total_comparisons",
        ]
    return f"""
SELECT 'run-1' AS run_id,
  CASE WHEN count(*) FILTER (WHERE engine = 'standard_inference') = 0 THEN 'failed'
    WHEN count(*) FILTER (WHERE engine = 'vllm_inference') = 0 THEN 'partial_success' ELSE 'success' END AS status,
  CAST(8 AS BIGINT) AS lora_r, 'q_proj,k_proj,v_proj,o_proj,gate_proj,up_proj,down_proj' AS target_modules,
  'adamw_8bit' AS optimizer, 'N/A' AS training_time, {', '.join(columns)}
FROM ({scored})
"""


ORACLES["run_record"] = record(f"SELECT evaluation_type AS engine, first, second, valid FROM ({SCORED})")
ORACLES["experiment_run"] = record(
    f"""
SELECT 'standard_inference' AS engine, {capped_words('"Problem"', 32)} AS first, {capped_words('"Problem"', 16)} AS second,
  true AS valid FROM ({PAIRS})
UNION ALL
SELECT 'vllm_inference', {capped_words('"Problem"', 6)}, {capped_words('"Problem"', 16)}, true FROM ({PAIRS})
"""
)
ORACLES["experiment_failures"] = f"""
SELECT failing, status, CAST(share * n AS BIGINT) AS errors
FROM (VALUES ('judge', 'failed', 2), ('engine', 'partial_success', 1), ('none', 'success', 0)) v(failing, status, share),
  (SELECT count(*) AS n FROM ({PAIRS}))
"""
_PLAIN_PROMPT = (
    f"{lit(INFERENCE_SYSTEM + chr(10) * 2 + '### Problem:' + chr(10))}"
    f" || \"Problem\" || {lit(chr(10) * 2 + '### Solution:')}"
)
ORACLES["engine_options"] = f"""
SELECT conv_id, turn,
  CASE WHEN long THEN NULL
    ELSE regexp_extract({_TUNED}, '^(?s:\\s*(?:[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s])){{0,8}}', 0) END AS generated_solution,
  CASE WHEN long THEN 'prompt too long' END AS error
FROM (SELECT *, len({TOKENS}) > 64 AS long FROM (SELECT *, {_PLAIN_PROMPT} AS text FROM ({PAIRS})))
"""
ORACLES["evaluate_from_file"] = ORACLES["evaluate_engine"]
ORACLES["outputs_written"] = f"""
SELECT kind, CASE WHEN kind = 'run success' THEN 1 ELSE n END AS n
FROM (SELECT unnest(['base', 'compared standard_inference', 'compared vllm_inference', 'run success']) AS kind),
  (SELECT count(*) AS n FROM ({PAIRS}))
"""
_N = """len(regexp_extract_all("Problem", '[^ \\n]+'))"""
_SAID = "'{\"first_score\": ' || least(10, %d, " + _N + ") || ', \"second_score\": ' || least(10, " + _N + ") || '}'"
ORACLES["outputs_values"] = f"""
SELECT 'base' AS kind, conv_id, turn, {_BASE} AS text FROM ({PAIRS})
UNION ALL SELECT 'standard_inference', conv_id, turn, {_SAID % 32} FROM ({PAIRS})
UNION ALL SELECT 'vllm_inference', conv_id, turn, {_SAID % 6} FROM ({PAIRS})
"""
ORACLES["experiment_counts"] = f"SELECT DISTINCT evaluation_type, CAST(2 AS BIGINT) AS experiments FROM ({RESPONSES})"
