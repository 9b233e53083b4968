import hashlib
import random

import pytest

from sparkprep.llm import suffix_dedup


def order(i):
    return float("inf") if i is None else i


def plain(rows, size):
    """Expected (id, bytes, removed, runs, digest of the rest) by dictionaries."""
    first = {}
    texts = [(order(i), (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - size + 1):
            key = t[p : p + size]
            first[key] = min(i, first.get(key, float("inf")))
    out = []
    for (i, t), (shown, _) in zip(texts, rows, strict=True):
        gone = bytearray(len(t))
        own = set()
        for p in range(len(t) - size + 1):
            key = t[p : p + size]
            if first[key] < i or key in own:
                gone[p : p + size] = b"\1" * size
            own.add(key)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for a, b in zip(b"\0" + gone, gone, strict=False) if b and not a)
        out.append((shown, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shown(found):
    return sorted(
        (
            (
                r.doc_id,
                r.n_bytes,
                sum(s.end - s.start for s in r.removed),
                len(r.removed),
                hashlib.sha256(r.kept).hexdigest(),
            )
            for r in found.collect()
        ),
        key=str,
    )


@pytest.mark.parametrize("size", [5, 30, 100])
def test_against_plain_version(docs, odd, texts, size):
    draw = random.Random(size)
    rows = [(i, t[:8000] if t else t) for i, t in odd] + [(100 + i, t) for i, t in texts[:20]]
    for _ in range(60):
        parts = [t for _, t in draw.sample(texts[:40], 2)]
        a, b = (draw.randint(0, min(900, len(p))) for p in parts)
        text = parts[0][:a] + parts[1][b : b + 700]
        if draw.random() < 0.5 and text:
            at = draw.randrange(len(text))
            text = text[:at] + "é" + text[at + 1 :]
        rows.append((draw.randint(-50, 200), text))
    rows += [(300 + i, "ab" * (30 + i) + "c" * i) for i in range(12)]
    rows += [(400, texts[0][1][:size]), (401, texts[0][1][: size - 1]), (402, "x" * size)]
    assert shown(suffix_dedup.remove_repeats(docs(rows), size)) == plain(rows, size)


def test_supplied_table(docs, texts):
    assert shown(suffix_dedup.remove_repeats(docs(texts))) == plain(texts, 100)


def test_empty_table(docs):
    assert suffix_dedup.remove_repeats(docs([])).collect() == []


def test_steps():
    assert suffix_dedup.lengths(100) == [25, 50, 100]
    assert suffix_dedup.offsets([25, 50, 100]) == [[0, 25, 50, 75], [0, 50], [0]]
    assert suffix_dedup.offsets([2, 4, 5]) == [[0, 1, 2, 3], [0, 1], [0]]
