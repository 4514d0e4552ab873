import random

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.decontaminate import SHORTEST, Matcher, budget, leaks, myers, normalised, pieces_of


def nearest(pattern, text):
    """Smallest edit distance of pattern to any passage of text, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        old, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (p != t))
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120))
def test_myers_is_the_edit_distance(pattern, text):
    assert myers(pattern, text)[0] == nearest(pattern, text)


def test_pieces_cover_the_item():
    assert "".join(p for _, p in pieces_of("abcdefghij", 3)) == "abcdefghij" and len(pieces_of("abcdefghij", 3)) == 4
    assert budget("x" * 200) == 16 and budget("short one") == 0


def test_all_within_budget_are_found():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(30)]
    matcher = Matcher(items)
    for i, item in items:
        chars, edits = list(item), rng.randrange(0, 2 * budget(item))
        for _ in range(edits):
            at = rng.randrange(len(chars))
            rng.choice((lambda: chars.insert(at, "q"), lambda: chars.pop(at), lambda: chars.__setitem__(at, "z")))()
        text = " ".join([word() for _ in range(60)] + ["".join(chars)] + [word() for _ in range(60)])
        found = {m[0]: m[1:] for m in matcher.matches(text)}
        least = nearest(item, normalised(text))
        assert (i in found) == (least <= budget(item))
        if i in found:
            assert found[i][0] == least and nearest(item, normalised(text)[found[i][1] : found[i][1] + found[i][2]]) == least
        assert set(found) <= {i}


def test_rows(spark):
    item = "The quick brown fox jumps over the lazy dog and runs"
    documents = [(1, f"x {item.upper()}\n y"), (1, f"x {item.upper()}\n y"), (2, None), (3, ""), (4, "a clean one"), (5, "z " * 30_000 + item), (6, "tiny words"), (7, "stiny words")]
    benchmark = [(10, item), (11, item.replace(" ", "\n")), (12, None), (13, " "), (14, "Tiny  words")]
    d = spark.createDataFrame([(*r, "u") for r in documents], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, "u") for r in benchmark], "item_id long, text string, doc_id string")
    found = sorted((r.doc_id, r.item_id, r.n_errors) for r in leaks(d, b).collect())
    assert found == sorted([(1, 10, 0), (1, 11, 0)] * 2 + [(5, 10, 0), (5, 11, 0), (6, 14, 0)])
    assert leaks(d, b.limit(0)).count() == 0 and leaks(d.limit(0), b).count() == 0
    assert SHORTEST > len("tiny words")
