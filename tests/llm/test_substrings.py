import hashlib
from collections import Counter

import pytest

from bibliospark.llm.common import LAST_ID, WORD
from bibliospark.llm.substrings import without_repeats


def brute(rows, window=13):
    owner = {}
    split = [(LAST_ID if i is None else i, WORD.findall(t or "")) for i, t, _ in rows]
    for i, words in split:
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            owner[key] = min(i, owner.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for a in range(len(words) - window + 1):
            if owner[tuple(words[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = " ".join(w for a, w in enumerate(words) if a not in gone)
        out.append((None if i == LAST_ID else i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("chars,windows", [(4_000_000, 6_000_000), (60_000, 5_000)])
def test_against_brute_force(small, small_rows, chars, windows):
    got = without_repeats(small, batch_chars=chars, shard_windows=windows).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(small_rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.removed) == r.n_removed for r in got)
    assert sum(r.n_removed > 0 for r in got) > 5


def test_empty(nothing):
    assert without_repeats(nothing).count() == 0
