import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii_offsets as g

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(digits):
    doubled = [int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(d * 2 // 10 + d * 2 % 10 for d in doubled)) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and passes_luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def test_base_equals_the_expressions():
    rng = random.Random(2)
    bits = list("ab1.@+- ()") + ["@a.b", "10.0.0.1", "4111111111111111", "255", "256", "+1 (555) 123-4567", "é", "٣", "\n"]
    for _ in range(30000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 16)))
        assert g.detect(text) == brute(text), text


@pytest.mark.parametrize("text, want", [
    ("mail john [at] mail (dot) com now", ["email:john [at] mail (dot) com"]),
    ("jane.doe at example dot co dot uk!", ["email:jane.doe at example dot co dot uk"]),
    ("jоhn@exаmple.com", ["email:jоhn@exаmple.com"]),
    ("john＠example．com", ["email:john＠example．com"]),
    ("john@mail[.]com", ["email:john@mail[.]com"]),
    ("a​b@c.com", ["email:a​b@c.com", "email:b@c.com"]),
    ("+one two three four five six seven eight nine", ["phone:+one two three four five six seven eight nine"]),
    ("10 dot 0 dot 0 dot 1", ["ip:10 dot 0 dot 0 dot 1"]),
    ("one nine two dot one six eight dot zero dot one x", ["ip:one nine two dot one six eight dot zero dot one"]),
    ("vier eins eins eins" + " eins" * 12, ["card:vier eins eins eins" + " eins" * 12]),
    ("４１１１１１１１１１１１１１１１", ["card:４１１１１１１１１１１１１１１１"]),
    ("we met at noon", []),
    ("look at this (at home) [dot] one two", []),
    ("a@b.com", ["email:a@b.com"]),
])
def test_disguises(text, want):
    _, every = g.spans(text)
    assert sorted(f"{g.KINDS[k]}:{text[a:b]}" for a, k, b in every) == sorted(want)


@pytest.mark.parametrize("text, want", [
    ("mail jane_at_mail.com now", ["email:jane_at_mail.com"]),
    ("jane-at-mail.co.uk.", ["email:jane-at-mail.co.uk"]),
    ("jane @ mail.com", ["email:jane @ mail.com"]),
    ("jane.doe@ mail.com, x", ["email:jane.doe@ mail.com"]),
    ("see http://x.org/look-at-this.html", []),
    ("we met at noon.", []),
    ("jºe@mail.com", ["email:e@mail.com", "email:jºe@mail.com"]),
    ("mªry@mail.com", ["email:mªry@mail.com", "email:ry@mail.com"]),
])
def test_plain_hosts_and_ordinals(text, want):
    _, every = g.spans(text)
    assert sorted(f"{g.KINDS[k]}:{text[a:b]}" for a, k, b in every) == sorted(want)


def test_quick_check_knows_every_latin_look_alike():
    for c in map(chr, range(128, 256)):
        assert g.suspicious(f"a{c}b") == (g._plain(c) != c)


def test_mapping_keeps_offsets():
    m = g.Mapped.of("abcdef").rewrite([(1, 3, "X"), (4, 4 + 1, "YZ")]).rewrite([(0, 1, "")])
    assert m.text == "XdYZf"
    assert list(zip(m.starts, m.ends)) == [(1, 3), (3, 4), (4, 5), (4, 5), (5, 6)]


def test_nothing_hidden_in_the_table(spark):
    """The quick test never hides what the transducers would find."""
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        if not g.suspicious(r.text):
            m = g.spelled_digits(g.signs(g.homoglyphs(g.Mapped.of(r.text))))
            assert m.text == r.text


def test_query(spark, corpus):
    rows = [(1, "a@b.com 10.0.0.1"), (2, None), (3, ""), (4, "x [at] y.com"), (4, "x [at] y.com"), (None, "+1 (555) 123-4567"), (5, "w " * 50000 + "4111 1111 1111 1111")]
    d = corpus(documents=spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, spans string"))
    got = sorted(tuple(r) for r in g.op3_pii_offsets(spark, d).where("doc_id is not null").collect())
    want = []
    for i, t in rows:
        base, every = g.spans(t or "")
        listed = lambda s: ",".join(f"{g.KINDS[k]}:{a}:{b}" for a, k, b in s)
        if i is not None:
            want.append((i, *(sum(k == n for _, k, _ in base) for n in range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
    assert got == sorted(want)
    assert g.op3_pii_offsets(spark, d).where("doc_id is null").first().n_phone == 1


def test_empty_table(spark, corpus):
    d = corpus(documents=spark.createDataFrame([], "doc_id long, text string"))
    assert g.op3_pii_offsets(spark, d).count() == 0


PIECES = ["card:four", "tel:one", "111", "1111", " ", " ", "one", "two", "(three", "four)", "-", ",", ".", ":", "/", "\n", " dot ", "_dot_", "jane", "_at_",
          " at ", "@", "mail.com", "mail", "[at]", "{dot}", "é", "º", "«five", "+", "10", "_six", "seven's", "е"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_quick_check_knows_whatever_is_rewritten(text):
    if g.spelled_digits(g.signs(g.homoglyphs(g.Mapped.of(text)))).text != text:
        assert g.suspicious(text)


def test_spelled_digits_after_a_colon():
    for text in ("card:four 111 1111 1111 1111", "tel:one 2 3 4"):
        assert g.suspicious(text)


def test_leading_zeros_of_any_number():
    zeros = "0" * 650
    assert [g.detect(f"at {zeros}1.{zeros}.3.255 now")[0][1]] == [1]
    assert g.detect(f"at {zeros}256.1.2.3") == []
