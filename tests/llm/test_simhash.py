import random

import pytest
import xxhash

from weir.llm.simhash import near_duplicates, one_of_each


def brute(rows):
    fps = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs)))
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return {rows[i][0]: (fps[i], min(r[0] for k, r in enumerate(rows) if comp[k] == comp[i])) for i in range(len(rows))}


def corpus():
    rng = random.Random(5)
    words = [f"wörd{i}" for i in range(60)] + ["The", "of", "And"]
    rows, base = [], [rng.choices(words, k=200) for _ in range(3)]
    for i in range(60):
        w = list(base[i % 3])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(60, None), (61, ""), (62, " \n\t"), (63, "one"), (64, "ONE"), (65, "one two"), (66, "x" * 50_000), (67, "a b c d " * 9000)]


def test_equals_brute_force(spark):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.id: (r.fp % 2**64, r.component) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_two_ways_of_postings_cover_every_pair_of_bytes():
    import weir.llm.simhash as s

    assert len(s.KEYS) == 6 and len(s.FREE) == 28 and all(not set(s.KEYS[s.WITHIN[k]]) & set(f) for k, f in enumerate(s.FREE))


@pytest.mark.parametrize("crowd", [512, 3])
def test_linked_fingerprints_are_found_whatever_bits_differ(spark, monkeypatch, crowd):
    import weir.llm.simhash as s

    monkeypatch.setattr(s, "CROWD", crowd)
    monkeypatch.setattr(s, "HOT", 50)
    rng = random.Random(1)
    fps = [(i, rng.getrandbits(64) - 2**63) for i in range(40)]
    for i, f in list(fps):
        for k in range(6):
            bits = rng.sample(range(64), rng.choice([1, 2, 3]))
            v = f % 2**64
            for b in bits:
                v ^= 1 << b
            fps.append((100 + 10 * i + k, v - 2**64 if v >> 63 else v))
    # a dense posting: many values of the same two bytes
    fps += [(1000 + i, i) for i in range(700)]
    fps += [(5000 + i, fps[0][1]) for i in range(60)]  # a hot one
    monkeypatch.setattr(s, "fingerprints", lambda d, *_: d)
    rows = s.near_duplicates(spark.createDataFrame(fps, "id bigint, fp bigint")).collect()
    got = {r.id: r.component for r in rows}
    assert len(rows) == len(fps)
    up = {i: i for i, _ in fps}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, f in fps:
        for j, g in fps:
            if i < j and ((f ^ g) % 2**64).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    assert got == {i: top(i) for i, _ in fps}


def test_one_of_each_with_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "a b c d e", None), (None, "q r s t u", "n"), (None, "q r s t u", "n"), (5, None, "z"), (6, "", None)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, fp string")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got) == [-1, 1, 5]
    assert got[0].asDict().keys() == {"doc_id", "text", "fp"}


def test_one_of_each_with_null_and_repeated_ids_of_other_texts(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, words(k), k) for k in range(5)] + [(None, words(4), 5)]  # null ids: five texts, one of them twice
    rows += [(7, words(10), 6), (7, words(11), 7)]  # one id, two texts
    rows += [(3, words(12), 8), (8, words(12), 9), (8, words(13), 10)]  # 8 stays for its own text only
    rows += [(9, words(0), 11)]  # an id comes before null
    got = one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, row int").repartition(3)).collect()
    at = {r.row for r in got}
    assert len(got) == len(at) and len(at & {4, 5}) == 1
    assert at - {4, 5} == {11, 1, 2, 3, 6, 7, 8, 10}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, id string")
    assert near_duplicates(empty).count() == 0
    assert one_of_each(empty).columns == ["doc_id", "text", "id"]
