import hashlib
import random

import pytest

from sparkprep.llm import merkle


def plain(rows):
    """Expected (id, n_chars, edited_sha256) by lists."""
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for at, (i, t) in enumerate(order):
        t, following = t or "", order[(at + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("runs", [1, 3, 40])
def test_edited_texts(docs, odd, texts, runs):
    rows = odd + [(20 + i, t) for i, t in texts[:60]]
    found = merkle.against_next(docs(rows), runs).collect()
    assert sorted((tuple(r)[:3] for r in found), key=str) == plain(rows)
    prints = {}
    for r in found:
        prints.setdefault(r.fingerprint, set()).add(r.doc_id)
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", set()).add(i)
    assert sorted(prints.values(), key=str) == sorted(by_text.values(), key=str)


def test_likeness_of_supplied_texts(docs, texts):
    found = merkle.against_next(docs(texts)).collect()
    long = [r for r in found if r.n_chars > 400]
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    assert sum(0.3 < r.near_edited < 0.75 for r in long) > 0.9 * len(long)
    assert sum(r.near_next < 0.3 for r in long) > 0.9 * len(long)


def test_empty_table_and_one_row(docs):
    assert merkle.against_next(docs([])).collect() == []
    (row,) = merkle.against_next(docs([(1, "abcd")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_tree_covers_the_text_and_agrees_with_the_fingerprint(odd, texts):
    for _, text in odd + texts[:30]:
        nodes = merkle.tree(text)
        assert merkle.fingerprint(text).root == nodes[-1].digest.hex()
        for level in (0, 1, 2):
            pieces = [(text or "")[n.start : n.end] for n in nodes if n.level == level]
            assert "".join(pieces) == (text or "")
        parsed = merkle.parsed(merkle.fingerprint(text).text())
        assert merkle.likeness(parsed, merkle.fingerprint(text)) == 1


def test_likeness_of_large_sets_is_near_the_true_share():
    draw = random.Random(3)
    words = [str(draw.random()) for _ in range(16_000)]
    first, second = " ".join(words[:12_000]), " ".join(words[4_000:])
    found = merkle.likeness(merkle.fingerprint(first), merkle.fingerprint(second))
    assert abs(found - 8 / 12) < 0.12


def test_edits_are_located(docs):
    paragraphs = [f"paragraph {i} has a few words of its own, number {i * i}.\n" for i in range(60)]
    old = "".join(paragraphs)
    place = old.index("paragraph 30")
    new = old.replace("paragraph 30 has", "paragraph 30 had")
    rows = [(2, "same text"), (3, None)]
    found = merkle.edits(
        merkle.nodes(docs([(1, old), *rows])), merkle.nodes(docs([(1, new), *rows]))
    ).collect()
    assert {r.doc_id for r in found} == {1}
    for side, text in (("old", old), ("new", new)):
        (row,) = [r for r in found if r.side == side]
        assert row.level == 0 and row.start <= place + 13 < row.end
        assert text[row.start : row.end].startswith("paragraph 30 ha")
