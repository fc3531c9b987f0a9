import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fim_frames as g

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = [None, "", " ", "a", "a b", "  a  b \n", "x　y\x85z \x0b", "< P> <P >", "says <M> here", "<<S", "<", "S>", "日本 語 🙂 é",
         "word " * 5000, "y" * 300_000, " \t\n" * 40_000, "<\n" * 3000, "a<S b<P c<M " * 900]


@pytest.fixture(scope="module")
def rows():
    out = [(i * len(TEXTS) + k, t, "f") for i in range(12) for k, t in enumerate(TEXTS)]
    return out + [(None, "without an id " * 30, "f"), (7, "same row", "f"), (7, "same row", "f"), (-5, "negative id", "f")]


def test_equals_brute_force(spark, corpus, rows):
    d = corpus(documents=spark.createDataFrame(rows, "doc_id long, text string, frames string"))
    got = [tuple(r) for r in g.op11_fim_frames(spark, d).collect()]
    want = []
    for i, t, _ in rows:
        *counts, out = brute(i, t)
        want.append((i, *counts, sha(out), sha(t or "")))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


@pytest.mark.parametrize("frame_units", [1, 3, 1024])
def test_outputs_and_the_way_back(spark, rows, frame_units):
    docs = spark.createDataFrame(rows, "doc_id long, text string, frames string")
    out = g.fill_in_middle(g.choose(g.seekable(docs.where("length(coalesce(text, '')) < 60000"), frame_units=frame_units)))
    kept = [r for r in rows if len(r[1] or "") < 60000]
    assert sorted((str(r.id), r.output) for r in out.collect()) == sorted((str(i), brute(i, t)[-1]) for i, t, _ in kept)
    assert sorted((str(r.id), r.text) for r in g.restore(out).collect()) == sorted((str(i), t or "") for i, t, _ in kept)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab< >PSM\n\x0b\x85日"), max_size=60), st.integers(1, 5), st.data())
def test_frames_seek(text, frame_units, data):
    import zstandard

    units, chars, blobs, n = g.frames_of(text, frame_units, zstandard.ZstdCompressor().compress)
    found = UNITS.findall(text)
    assert n == len(found) and "".join(found) == text
    frames = g.Frames([*chars, len(text)], blobs)
    assert "".join(frames.read(0, len(text))) == text
    low, high = sorted(data.draw(st.integers(0, len(text))) for _ in range(2))
    assert "".join(frames.read(low, high)) == text[low:high]
    for u in range(n + 1):
        assert g.character_of(u, n, units, frames) == len("".join(found[:u]))


def test_a_cut_reads_one_frame(monkeypatch):
    import zstandard

    units, chars, blobs, n = g.frames_of("w " * 10_000, 100, zstandard.ZstdCompressor().compress)
    frames, read = g.Frames([*chars, 20_000], blobs), []
    monkeypatch.setattr(frames, "frame", lambda k, real=frames.frame: read.append(k) or real(k))
    assert g.character_of(5_050, n, units, frames) == 10_099 and read == [50]


def test_marks_across_chunks():
    assert g.find_marks([b"a<", b"P", b">b<S", b">", b"<M>"], [b"<P>", b"<S>", b"<M>"]) == [1, 5, 8]


def test_other_parameters(spark, docs_df):
    docs = docs_df(["one two three four"] * 200)
    forms = {r.form for r in g.choose(g.seekable(docs), fim_percent=100, spm_percent=0).collect()}
    assert forms == {"psm"}
    assert {r.form for r in g.choose(g.seekable(docs), fim_percent=0).collect()} == {"plain"}


def test_empty_table(spark, corpus):
    d = corpus(documents=spark.createDataFrame([], "doc_id long, text string"))
    assert g.op11_fim_frames(spark, d).count() == 0
