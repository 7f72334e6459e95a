import random

import xxhash

from citeloom.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest index reachable for a list of fingerprints."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprints_equal_the_definition():
    draw = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 30, 400]:
        text = "".join(draw.choice(["Abc", "É", "x y", "ß", "\x1c"]) + draw.choice(" \n\t\r\x0b\f") for _ in range(n))
        assert S.simhash(text) == brute_fingerprint(text)
    assert S.simhash(None) == 0 == S.simhash(" \n")


def test_components_equal_brute_force(spark):
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = list(base)
    for _ in range(900):  # chains and balls of near fingerprints
        f = draw.choice(fps[-60:] if draw.random() < 0.7 else fps)
        for _ in range(draw.randint(0, 4)):
            f ^= 1 << draw.randrange(64)
        fps.append(f)
    rows = list(enumerate(fps))
    df = spark.createDataFrame([(S._signed(f),) for f in set(fps)], "fp long")
    want = brute_components(fps)
    for hot in (4, S.HOT_BLOCK, 10**6):
        edges = S.links(df, hot)
        label = {r.node: r.label for r in S.connected_components(edges).collect()}
        of = {}
        for (i, f), w in zip(rows, want):
            of.setdefault(label.get(S._signed(f), S._signed(f)), set()).add(w)
        assert all(len(x) == 1 for x in of.values()) and len(of) == len(set(want)), hot


def test_query_over_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    near = text + " "
    rows = [(5, text, "x", 1), (3, near, None, 2), (9, None, "x", 3), (8, " ", "x", 3), (8, " ", "x", 3), (7, "one", "y", 1), (None, text, "n", 0), (None, "only here without id and so on", "n", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = S.classes(docs).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in out}
    full = f"{brute_fingerprint(text):016x}"
    assert got[5, full] == 3 and got[3, full] == 3 and got[None, full] == 3
    assert got[9, "0" * 16] == 8 and got[8, "0" * 16] == 8
    kept = sorted(((r.doc_id, r.text) for r in S.deduplicate(docs).collect()), key=str)
    assert kept == sorted([(3, near), (8, " "), (7, "one"), (None, "only here without id and so on")], key=str)
    assert S.deduplicate(docs).columns == docs.columns
    assert S.classes(docs.limit(0)).count() == 0 == S.deduplicate(docs.limit(0)).count()
