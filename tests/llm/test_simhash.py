import random
import re
from itertools import combinations

import xxhash
from helpers import clashing, docs, edge_rows, prose

from reportloom.llm import simhash
from reportloom.llm.queries_simhash import op13_simhash_components
from reportloom.llm.simhash import BITS, MOST, fingerprint, links, masks, near_copies


def slow_print(text) -> int:
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(ids: list, prints: list[int]) -> list:
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def expected(rows):
    prints = [slow_print(r[1]) for r in rows]
    return sorted(map(str, zip([r[0] for r in rows], [f"{p:016x}" for p in prints], slow_components([r[0] for r in rows], prints), strict=True)))


def test_any_two_positions_lie_outside_of_a_mask():
    for left in (list(range(BITS)), list(range(3, 30)), [1, 5, 9]):
        found = masks(left, 2)
        assert len(found) == 7
        for a, b in combinations(left, 2):
            assert any(not (m >> a & 1 or m >> b & 1) for m in found)
    worst = BITS
    for _ in range(3):
        worst = max(worst - m.bit_count() for m in masks(list(range(worst)), 2))
    assert 2**worst <= MOST


def test_slices_do_not_change_fingerprints(monkeypatch):
    text = (prose(3000, 4) + " " + "y" * 500 + "\t\n" + prose(50, 5)).encode()
    want = fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 64)
    assert fingerprint(text) == want == slow_print(text.decode()) - ((1 << 64) if slow_print(text.decode()) >> 63 else 0)


def test_edges_match_brute_force(spark):
    rows = edge_rows()
    got = near_copies(clashing(docs(spark, rows)).repartition(3)).collect()
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == expected(rows)


def test_query_on_copies_and_small_edits(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for base in range(12):
        words = prose(300, 500 + base).split()
        for _ in range(12):
            w = list(words)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(w), "en", "s", 1))
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_simhash_components(spark, str(tmp_path)).collect()
    want = expected(rows)
    assert sorted(map(str, ((x.doc_id, x.fingerprint, x.component_id) for x in got))) == want
    assert len({w.split(", ")[2] for w in want}) < len(rows) / 2


def test_crowded_buckets_lose_no_link(spark):
    """Thousands of fingerprints agree under each mask, so all levels are used."""
    r = random.Random(3)
    prints = set()
    for _ in range(4):
        centre = r.getrandbits(64)
        for _ in range(700):
            p = centre
            for k in r.sample(range(64), r.randrange(0, 7)):
                p ^= 1 << k
            prints.add(p - (1 << 64) if p >> 63 else p)
    got = {(x.a, x.b) for x in links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(prints), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert len(got) > 1000


def test_empty(spark):
    assert near_copies(docs(spark, [])).count() == 0
