"""Compiled templates against the same rules spelled out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.catalog import fixtures
from tabloom.functions.templates import TemplateError, compile_template

SCHEMA = "id int, messages array<struct<role:string,content:string>>, word string"
CHATS = [
    [("system", "Be kind."), ("user", " hi {{x}} "), ("assistant", "hello\n")],
    [("user", "a"), ("assistant", None), ("user", "it's \"b\"")],
    [], None, [("tool", "t")],
]


def run(spark, template, chats=CHATS, **options):
    rows = spark.createDataFrame([(i, c, "w") for i, c in enumerate(chats)], SCHEMA)
    text = compile_template(template, F.col("messages"), **options)
    return [r["t"] for r in rows.select("id", text.alias("t")).orderBy("id").collect()]


def chatml(chat, generation):
    lines = "".join(f"<|im_start|>{r}\n{c or ''}<|im_end|>\n" for r, c in chat or [])
    return lines + ("<|im_start|>assistant\n" if generation else "")


def bracketed(chat):
    chat, system = chat or [], ""
    if chat and chat[0][0] == "system":
        system, chat = f"<<SYS>>\n{chat[0][1]}\n<</SYS>>\n\n", chat[1:]
    out = ""
    for at, (role, content) in enumerate(chat):
        content = (system if at == 0 else "") + (content or "")
        if role == "user":
            out += f"<s>[INST] {content.strip()} [/INST]"
        elif role == "assistant":
            out += f" {content.strip()} </s>"
    return out


def effortful(chat, effort, generation):
    out = f"<|start|>system<|message|>Reasoning: {effort or 'medium'}<|end|>"
    for at, (role, content) in enumerate(chat or []):
        name = "developer" if role == "system" else role
        last = at == len(chat) - 1
        ending = "<|return|>" if last and role == "assistant" and not generation else "<|end|>"
        out += f"<|start|>{name}<|message|>{content or ''}{ending}"
    return out + ("<|start|>assistant" if generation else "")


@pytest.mark.parametrize("generation", [True, False])
def test_chatml(spark, generation):
    assert run(spark, fixtures.TEMPLATES["chatml"], generation=generation) == [chatml(c, generation) for c in CHATS]


def test_bracketed(spark):
    assert run(spark, fixtures.TEMPLATES["bracketed"], bos_token="<s>", eos_token="</s>") == [bracketed(c) for c in CHATS]


@pytest.mark.parametrize("effort", [None, "high"])
@pytest.mark.parametrize("generation", [True, False])
def test_effort(spark, effort, generation):
    options = {} if effort is None else {"reasoning_effort": effort}
    got = run(spark, fixtures.TEMPLATES["effortful"], generation=generation, **options)
    assert got == [effortful(c, effort, generation) for c in CHATS]


@pytest.mark.parametrize(
    "template, expected",
    [
        ("plain", "plain"), ("a {{ 'b' }} {# no #}c", "a b c"), ("x  {{- 'y' -}}  z", "xyz"), ("{% if true %}\nline\n{% endif %}\nend", "line\nend"),
        ("{{ 'it\\'s' + \"\\n\" ~ 3 }}", "it's\n3"), ("{% set a = 'v' %}{{ a|upper }}{{ ' q '|trim }}", "Vq"),
        ("{% if nothing is defined %}{{ nothing }}{% elif word == 'w' %}W{% else %}E{% endif %}", "W"),
        ("{% if not flag and (word in 'owl') %}1{% endif %}{{ none }}", "1"), ("{{ messages[0].role }}/{{ messages[5]['role'] }}", "system/"),
        ("{% for m in messages %}{{ loop.index }}{% if loop.first %}F{% endif %}{% if loop.last %}L{% endif %};{% endfor %}", "1F;2;3L;"),
        ("{% for m in messages %}{% if m.role != 'user' %}{{ m['role'] }},{% endif %}{% endfor %}!", "system,assistant,!"),
        ("{% if messages[0]['role'] == 'system' %}{% set s = messages[0]['content'] %}{% else %}{% set s = 'none' %}{% endif %}{{ s }}", "Be kind."),
        ("{% if messages[0].role == 'user' %}{{ raise_exception('no') }}{% endif %}ok", "ok"), ("{{ extra }}", "column w"),
        ("{% if messages[1:] %}{% for m in messages[2:] %}{{ m.content }}{% endfor %}{% endif %}", "hello\n"),
    ],
)
def test_language(spark, template, expected):
    options = {"flag": False, "word": "w", "extra": F.concat(F.lit("column "), F.col("word"))}
    assert run(spark, template, CHATS[:1], **options) == [expected]


@pytest.mark.parametrize(
    "template", ["{{ missing }}", "{% if x %}", "{% for m in messages %}", "{{ 'a' | shout }}", "{% while 1 %}", "{{ 'a' 'b' }}", "{{ messages }}",
                 "{% for a in messages %}{% for b in messages %}{% endfor %}{% endfor %}", "{{ loop.first }}", "{{ a..b }}", "{% set 1 = 2 %}", "{{ ? }}", "{{ }}"],
)
def test_what_is_refused(template):
    with pytest.raises(TemplateError):
        compile_template(template, F.col("messages"), x=True)


def test_a_reached_exception_fails(spark):
    with pytest.raises(Exception, match="roles must alternate"):
        run(spark, "{% if messages[0].role == 'system' %}{{ raise_exception('roles must alternate') }}{% endif %}")


def test_one_expression_without_shuffle(spark):
    rows = spark.range(3).selectExpr("array(named_struct('role', 'user', 'content', cast(id AS string))) AS messages")
    plan = rows.select(compile_template(fixtures.TEMPLATES["chatml"], F.col("messages")).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
