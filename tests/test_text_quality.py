"""C1-C6 against Python string semantics; F1-F10 on hand-made rows with their reasons written out."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.config import QualityConfig
from tessera.functions.text import PY_WHITESPACE, alnum_ratio, avg_line, header, n_chars, n_lines, py_strip
from tessera.operators.quality import quality_filter, reject_funnel, reject_reason

EDGE = [
    "", "a", "\n", "a\n", "a\r\nb", "a\rb\n", "a\x0bb\x0cc", "x\x1cy\x1dz\x1e", "\x85  ",
    "line\n\n\nlast", "trailing\r\n", "\r\n\r\n", "éé́", "日本語\n테스트", "١٢٣ abc", "\t tab 　",
    "a​b", "\U0001F600 emoji\n",
]


def signals(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rows = df.select(
        "i", n_chars("t").alias("c"), n_lines("t").alias("l"), avg_line("t").alias("a"),
        alnum_ratio("t").alias("r"), header("t", 5).alias("h"), py_strip("t").alias("s"),
    ).orderBy("i").collect()
    return rows


def test_signals_match_python_on_edge_strings(spark):
    for text, row in zip(EDGE, signals(spark, EDGE)):
        assert row.c == len(text)
        assert row.l == len(text.splitlines()), repr(text)
        assert row.a == len(text) / max(len(text.splitlines()), 1)
        if text:
            assert row.r == sum(ch.isalnum() for ch in text) / len(text), repr(text)
        assert row.h == text[:5].lower()
        assert row.s == text.strip(), repr(text)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1 é\n\r\t\x0b\x85 .,") + [PY_WHITESPACE[-1]]),
                        max_size=30), min_size=1, max_size=20))
def test_signals_match_python_random(spark, texts):
    for text, row in zip(texts, signals(spark, texts)):
        assert row.l == len(text.splitlines())
        assert row.s == text.strip()


def valid_code(lines=10, width=40):
    body = ["def f(x):"] + [f"    y{i} = x + {i}  # " + "c" * max(0, width - 20) for i in range(lines - 1)]
    return "\n".join(body) + "\n"


CODE = QualityConfig(profile="code")


def reasons(spark, texts, cfg):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.reason for r in reject_reason(df, cfg).orderBy("doc_id").collect()]


def padded_code(n_chars_total):
    """Valid code of exactly ``n_chars_total`` characters, 8+ lines, average line length in range."""
    text = "def f(x):\n" + "    x = 1\n" * 7
    extra = n_chars_total - len(text)
    assert extra >= 0
    while extra > 0:
        take = min(150, extra)
        text += "\n" if take == 1 else "#" + "x" * (take - 2) + "\n"
        extra -= take
    return text


def test_every_reason(spark):
    texts = [
        None, "",
        "value_number = 12345 + 67890\n" * 10,  # structure missing
        valid_code(10, 40),
        valid_code(7, 40),
        valid_code(8, 40),
        "def f():\n    return (1,\n" + "        2222222222222222,\n" * 10,  # unclosed bracket
        "def f():\n\tif 1:\n        pass\n" + "    x = 1  # padding padding\n" * 8,  # mixed tabs
        "def f():\n    pass  # \x00 nul\n" + "    x = 1  # padding padding\n" * 8,
        "# DO NOT EDIT\n" + valid_code(10, 40),
        valid_code(10, 40) + "#" + "z" * 1100 + "\n# do not edit\n",
        "def f(x):\n" + ("    (" * 200 + "x" + ")" * 200 + "\n") + "    pass\n" * 8,
    ]
    assert reasons(spark, texts, CODE) == [
        "chars", "chars", "structure", "keep", "lines", "keep", "syntax", "syntax", "nul", "autogen", "keep", "alnum",
    ]


@pytest.mark.parametrize("n,expected", [(199, "chars"), (200, "keep"), (80_000, "keep"), (80_001, "chars")])
def test_size_bounds(spark, n, expected):
    text = padded_code(n)
    assert len(text) == n
    assert reasons(spark, [text], CODE) == [expected]


def test_average_line_and_alnum_bounds(spark):
    prose = QualityConfig(profile="prose")
    # 20 lines of exactly 10 chars incl. newline -> average 10.0 (kept); 9.99 rejected
    ten = ("abcdefghi\n" * 20)
    short = ten[:-1] + "\n" * 0  # 199 chars, fails size first
    ratio_ok = ("a" + "." * 4) * 40 + "\n" * 0  # ratio exactly 0.2
    lines_ratio_ok = "\n".join([ratio_ok[i:i + 20] for i in range(0, len(ratio_ok), 20)])
    texts = [ten, short, lines_ratio_ok, lines_ratio_ok.replace("a", ".", 1)]
    assert reasons(spark, texts, prose) == ["keep", "chars", "alnum", "alnum"]


def test_filter_equals_keep_reason_and_funnel(spark, docs_df):
    texts = [valid_code(10, 40), None, "short", valid_code(10, 40).replace("def", "deff"), valid_code(3, 10)]
    df = docs_df(texts)
    kept = {r.doc_id for r in quality_filter(df, CODE).collect()}
    by_reason = {r.doc_id for r in reject_reason(df, CODE).where("reason = 'keep'").collect()}
    assert kept == by_reason
    funnel = {r.reason: r.n_docs for r in reject_funnel(df, CODE).collect()}
    assert sum(funnel.values()) == len(texts)


def test_first_failing_rule_gives_the_reason(spark):
    """Each text breaks the named rule and every later one."""
    nul = "\x00"
    bad_tail = "..." + nul  # no structure marker, a NUL
    texts = {
        "chars": "." + bad_tail,
        "lines": ("." * 300) + bad_tail,
        "avg_line": "\n".join(["..."] * 100) + bad_tail,
        "alnum": "\n".join(["." * 30] * 10) + bad_tail,
        "autogen": "# DO NOT EDIT abc\n" + "\n".join(["word word word"] * 20) + bad_tail,
        "structure": "\n".join(["word word word"] * 20) + bad_tail,
        "nul": "def f():\n" + "\n".join(["word word word"] * 20) + bad_tail,
        "syntax": "def f():\n" + "\n".join(["word word word"] * 20),
    }
    assert reasons(spark, list(texts.values()), CODE) == list(texts)


PROSE = QualityConfig(profile="prose")


def test_fixture_average_line_bounds(spark):
    cases = {
        "avg 9.99": ("abcdefghi\n" * 99 + "abcdefghi", "avg_line"),         # 999 chars / 100 lines
        "avg 10": ("abcdefghi\n" * 20, "keep"),                             # 200 / 20
        "avg 200": (("a" * 199 + "\n") * 10, "keep"),                       # 2000 / 10
        "avg 200.01": (("a" * 199 + "\n") * 99 + "a" * 201, "avg_line"),    # 20001 / 100
    }
    texts = [t for t, _ in cases.values()]
    for t, (text, _) in zip(cases, cases.values()):
        n, lines = len(text), len(text.splitlines())
        assert {"avg 9.99": 9.99, "avg 10": 10, "avg 200": 200, "avg 200.01": 200.01}[t] == n / lines
    assert reasons(spark, texts, PROSE) == [want for _, want in cases.values()]


def test_fixture_line_count_rules(spark):
    line = "a line of text\n"
    texts = [
        line * 6 + "x" * 200,            # 7 lines, last one without terminator
        line * 7 + "x" * 200,            # 8 lines, last one without terminator
        line * 7 + "x" * 200 + "\n",     # 8 lines, last one with terminator
        (line * 7).replace("\n", "\r\n") + "x" * 200,  # \r\n counted once: 8 lines
    ]
    assert [len(t.splitlines()) for t in texts] == [7, 8, 8, 8]
    assert reasons(spark, texts, PROSE) == ["lines", "keep", "keep", "keep"]


def test_fixture_alnum_ratio_bound(spark):
    at_bound = ("aa" + "." * 7 + "\n") * 20     # 200 chars, 40 alphanumeric: exactly 0.20, kept
    under = at_bound.replace("a", ".", 1)        # 39 / 200 = 0.195, rejected
    assert sum(c.isalnum() for c in at_bound) / len(at_bound) == 0.2
    assert reasons(spark, [at_bound, under], PROSE) == ["keep", "alnum"]
