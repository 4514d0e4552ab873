import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from granary.llm import sentencepiece_bpe as sp  # noqa: E402

KNOWN = sp.Known(sp.Agenda(sp.model_path()))
LIBRARY = KNOWN.agenda.library


def same(text):
    ids, decoded = sp.encode_text(KNOWN, text)
    theirs = LIBRARY.encode(text)
    assert ids == ",".join(map(str, theirs)) and decoded == LIBRARY.decode(theirs)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text("ab th\n\t▁ eé中<s>0x😀 ﬁ", max_size=60))
def test_texts_near_the_rules(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", " a", "a ", "x" * 3000, "ab" * 5000, " " * 500, "the " * 2000, "<s></s><unk><0x0A>", "▁▁a"])
def test_long_and_odd(text):
    same(text)


def test_both_agendas_agree():
    for word in ("▁thereafter", "unbelievable", "aaaaaaaaaaaaaaaaaaaa", "▁▁▁▁▁x", "中中中"):
        assert KNOWN.agenda.merged(word) == KNOWN.agenda.merged_short(word)


def test_a_difference_is_an_error():
    known = sp.Known(KNOWN.agenda)
    known.new.append(("▁word", [1, 2, 3], "x"))
    with pytest.raises(ValueError, match="library"):
        known.check("", "", "")
    ids = LIBRARY.encode("word")
    for wrong in (("word", "1,2", "word"), ("word", ",".join(map(str, ids)), "wörd")):
        with pytest.raises(ValueError, match="whole text"):
            sp.Known(KNOWN.agenda).check(*wrong)


def test_what_is_kept_changes_nothing(monkeypatch):
    monkeypatch.setattr(sp, "MOST_KEPT", 3)
    known = sp.Known(KNOWN.agenda)
    for text in ("a b c d e\nf", "c d\n\ne x", "a b c", "f\nf g ü 😀😀 中", "a a a") * 2:
        found = sp.encode_text(known, text)
        assert found == (",".join(map(str, LIBRARY.encode(text))), text)
        known.check(text, *found)
    assert len(known) + len(known.older) < 30


@pytest.mark.parametrize("digest", [False, True])
def test_a_batch_is_coded_in_bounded_parts(monkeypatch, digest):
    """However many texts an Arrow batch has, what waits for the check and what is given on at once are of one part."""
    monkeypatch.setattr(sp, "CHARS_AT_ONCE", 400)
    texts = [" ".join(f"w{k}x{j}" for j in range(10)) for k in range(60)] + ["", "y " * 900, ""]
    waiting = []

    class Watched(sp.Known):
        def check(self, *longest):
            waiting.append(len(self.new))
            super().check(*longest)

    found = list(sp.coded_parts(iter([pa.array(texts[:50]), pa.array([], pa.string()), pa.array(texts[50:])]), Watched(KNOWN.agenda), digest))
    assert len(found) == len(waiting) > 9 and max(waiting) <= 100
    hexed = (lambda x: hashlib.sha256(x.encode()).hexdigest()) if digest else str
    expected = [(len(i := LIBRARY.encode(t)), hexed(",".join(map(str, i))), hexed(LIBRARY.decode(i))) for t in texts]
    assert [tuple(r.values()) for part in found for r in part.to_pylist()] == expected


def test_batches_of_several_parts(spark):
    """Rows keep their own results where a batch is given on in parts."""
    text = F.concat(F.repeat(F.lit("word and "), 20_000), F.col("id").cast("string"))
    found = spark.range(0, 60, 1, 1).select("id", text.alias("text")).select("id", "text", sp.coded(F.col("text"), sp.model_path()).alias("c"))
    assert found.filter("c.decoded = text").count() == 60


def test_rows(spark):
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (2, None), (3, "")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    found = frame.select("doc_id", sp.coded(F.col("text"), sp.model_path(), digest=True).alias("c")).select("doc_id", "c.*").collect()
    ids = LIBRARY.encode("Hello  world\n")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert len(found) == 4
    for r in found:
        assert (r.n_tokens, r.ids, r.decoded) == ((len(ids), digest(",".join(map(str, ids))), digest("Hello  world\n")) if r.doc_id == 1 else (0, digest(""), digest("")))
    assert frame.limit(0).select(sp.coded(F.col("text"), sp.model_path()).alias("c")).count() == 0


def test_new_segments_are_encoded_together(monkeypatch):
    """A part's new words take no Python agenda each; only ties, bytes and unknown characters do, with the library's ids all the same."""
    alone = []

    class Watched(sp.Agenda):
        def encode_segment(self, segment):
            alone.append(segment)
            return super().encode_segment(segment)

    words = [f"w{k % 97}ord{'abcdefghij'[k % 10] * (k % 7)}{k}" for k in range(3_000)]
    texts = [" ".join(words[k : k + 10]) for k in range(0, 3_000, 10)] + ["a    b\n\n  c", "x 中é😀ﷺ y\nThe the", "▁▁a  " + "z" * 300, "", "\n"]
    found = list(sp.coded_parts(iter([pa.array(texts)]), sp.Known(Watched(sp.model_path())), False))
    assert [(r["ids"], r["decoded"]) for part in found for r in part.to_pylist()] == [(",".join(map(str, i := LIBRARY.encode(t))), LIBRARY.decode(i)) for t in texts]
    assert len(alone) < 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab th\n\t▁ eé中0x😀  ", max_size=70), max_size=8))
def test_any_batch(texts):
    found = list(sp.coded_parts(iter([pa.array(texts, pa.string())]), sp.Known(KNOWN.agenda), False))
    assert [(r["ids"], r["decoded"]) for part in found for r in part.to_pylist()] == [(",".join(map(str, i := LIBRARY.encode(t))), LIBRARY.decode(i)) for t in texts]


@pytest.mark.parametrize("wrong", ["ids", "decoded"])
def test_a_difference_in_a_block_is_an_error(monkeypatch, wrong):
    monkeypatch.setattr(sp, "CHECKED_AT_ONCE", 3)
    known = sp.Known(KNOWN.agenda)
    known.learn({"▁word", "▁work", "▁wand", "▁walk", "abcd", "▁more"})
    some, ids, decoded = known.blocks[-1]
    if wrong == "ids":
        ids[-1, -1] += 1
    else:
        decoded[-1] += "x"
    with pytest.raises(ValueError, match="library"):
        known.check("", "", "")


def test_blocks_wait_for_one_part_only(monkeypatch):
    monkeypatch.setattr(sp, "CHARS_AT_ONCE", 400)
    waiting = []

    class Watched(sp.Known):
        def check(self, *longest):
            waiting.append(sum(len(b[0]) for b in self.blocks))
            super().check(*longest)
            assert not self.blocks

    texts = [" ".join(f"w{k}x{j}" for j in range(10)) for k in range(60)]
    list(sp.coded_parts(iter([pa.array(texts)]), Watched(KNOWN.agenda), False))
    assert 0 < max(waiting) <= 100
