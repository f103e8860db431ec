"""SimHash near-duplicates, spelling variants and fill-in-middle against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import fill_middle, pii, sharding, simhash, spelling
from lodestone.llm.common import materialize

ODD = ["", None, " \t\n", "a", " A  b", "A b\nC", "ünï 中文 😀 d", "\t x y z w v \r\n", "x" * 9000, "word " * 4000, "same text here", "same text here", "SAME text\there"]


def documents(spark, texts, ids=None):
    rows = [(i, t, "clash", 1.5) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, word double")


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, bits=3):
    """The smallest id that each row reaches, by trying all pairs."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= bits:
                label[find(i)] = find(j)
    lows = {}
    for i, id in enumerate(ids):
        root = find(i)
        lows[root] = id if lows.get(root) is None else lows[root] if id is None else min(lows[root], id)
    return [lows[find(i)] for i in range(len(fps))]


def mixed_texts(n):
    random.seed(n)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(n):
        base = [random.choice(words) for _ in range(random.randint(1, 150))]
        texts.append(" ".join(base))
        for _ in range(random.choice((0, 0, 1, 4))):  # near copies: a word or two differ
            other = list(base)
            other[random.randrange(len(other))] = random.choice(words)
            texts.append(" ".join(other))
    return texts


def test_fingerprints_and_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 20)  # many shards and blocks, also of few rows
    monkeypatch.setattr(simhash, "LEAST_IN_LEAF", 4)
    monkeypatch.setattr(simhash, "MOST_ASKERS", 32)
    monkeypatch.setattr(simhash, "MOST_MEMBERS", 16)
    texts = mixed_texts(120)
    ids = [7 * i % 1009 for i in range(len(texts))]
    ids[40], ids[41] = None, ids[42]  # a null id and a repeated one
    rows = simhash.near_duplicates(documents(spark, texts, ids).repartition(3)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    want = sorted((str(i), f"{f:016x}", str(c)) for i, f, c in zip(ids, fps, components(fps, ids)))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == want
    assert {"0" * 16} == {f"{fps[i]:016x}" for i in (0, 1, 2)} and len({c for _, _, c in want}) < len(set(fps))
    assert simhash.near_duplicates(nothing(spark)).count() == 0


def test_links_among_close_fingerprints(spark, monkeypatch):
    """Dense groups of fingerprints, which the first half of the bits can't tell apart."""
    monkeypatch.setattr(simhash, "DIRECT", 64)
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**63, 60, dtype=np.uint64)
    ball = np.full(700, points[0])
    for _ in range(4):
        ball ^= np.uint64(1) << rng.integers(0, 32, len(ball)).astype(np.uint64)
    points = np.unique(np.concatenate([points, ball, points ^ np.uint64(7)]))
    want = {(a, b) for a in range(len(points)) for b in np.flatnonzero(np.bitwise_count(points ^ points[a]) <= 3).tolist()}
    got = set()
    for half in (0, 1):
        for x, y in simhash.near_pairs(points, points, 3, half):
            got |= set(zip(x.tolist(), y.tolist()))
    assert got == want
    tree = simhash.Tree.grow(points, simhash.HALVES[1], 8)
    own, home = tree.route(points, 0)
    assert sorted(own.tolist()) == list(range(len(points)))  # each has one home
    asked = set(zip(*(x.tolist() for x in tree.route(points, 1))))
    homes = dict(zip(own.tolist(), home.tolist()))
    close = np.bitwise_count((points[:, None] ^ points[None, :]) & simhash.HALVES[1]) <= 1
    assert all((a, homes[b]) in asked for a, b in zip(*(x.tolist() for x in np.nonzero(close))))


def test_many_copies_are_one_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    texts = ["one two three four five"] * 50 + ["six seven eight nine"] + [""] * 3
    rows = simhash.near_duplicates(documents(spark, texts)).collect()
    assert len(rows) == 54 and {r["component_id"] for r in rows} == {0, 50, 51}


# --- spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_variants(texts, ids):
    counts = {}
    for id, text in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= 7:
                counts[word] = counts.get(word, 0) + 1
    words = {w: n for w, n in counts.items() if n >= 2}
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [w, n, len(others), form, form and words[form], w]
    for row in out.values():
        while out[row[5]][3]:
            row[5] = out[row[5]][3]
    return sorted(tuple(r) for r in out.values())


def test_spelling_variants(spark):
    random.seed(3)
    letters = "abéÿß"
    stems = ["".join(random.choice(letters) for _ in range(random.randint(7, 12))) for _ in range(25)]

    def slip(w):
        i = random.randrange(len(w))
        return random.choice((w[:i] + w[i + 1 :], w[:i] + random.choice(letters) + w[i + 1 :], w[:i] + random.choice(letters) + w[i:]))

    texts = []
    for i in range(150):
        words = random.choices(stems, weights=[2.0**-k for k in range(25)], k=30) + [slip(random.choice(stems)) for _ in range(12)]
        texts.append(" ".join(w.upper() if i % 7 == 0 else w for w in words))
    texts += [*ODD, "aaaaaaaa aaaaaaaa aaaaaaaab aaaaaaaab ×÷×÷×÷×÷ ×÷×÷×÷×÷ short short"]
    texts += ["harbours " * 300, "harboursx " * 25, "harboursxy harboursxy"]  # the last leads to the first
    ids = [*range(len(texts))]
    ids[3], ids[4] = None, ids[5]
    rows = spelling.spelling_variants(documents(spark, texts, ids)).collect()
    want = plain_variants(texts, ids)
    assert sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows) == want
    assert sum(w[3] is not None for w in want) > 20 and any(w[5] != w[3] and w[3] for w in want) and any(w[1] == 2 for w in want)
    assert spelling.spelling_variants(nothing(spark)).count() == 0


def test_long_words_have_all_near_words(spark, monkeypatch):
    """Words beyond LONGEST go by the hashes of their deletions; pairs across the border are found from both sides."""
    monkeypatch.setattr(spelling, "LONGEST", 9)
    random.seed(4)
    words = {"".join(random.choice("ab") for _ in range(random.randint(7, 12))) for _ in range(220)} | {"a" * 5000, "a" * 5001, "a" * 2500 + "b" + "a" * 2499}
    table = materialize(spark.createDataFrame([(w, i % 9 + 2) for i, w in enumerate(sorted(words))], "word string, n long"), "test-words")
    counts = {r["word"]: r["n"] for r in table.collect()}
    got = {r["word"]: (r["n_near"], r["near"], r["near_n"]) for r in spelling.near_words(table).collect()}
    for w in words:
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        assert got.get(w) == ((len(others), best, counts[best]) if others else None), w


# --- fill-in-middle


def plain_fim(id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("step", [40, 1 << 21])
def test_fill_in_middle(spark, monkeypatch, step):
    random.seed(step)
    parts = ["a", " ", "\n", "\t\x0b", "wörd", "中文", "😀", "<", "P>", "<P>", "<S", ">", "<M>", " x y", " ", "z" * 30]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(500)] + ODD + ["ends in <", "P> begins", "<<S>", " ", "\n\n"]
    ids = [*range(len(texts))]
    ids[3], ids[4] = None, ids[5]
    monkeypatch.setattr(fill_middle, "text_chunks", lambda batch: __import__("lodestone.llm.common", fromlist=["x"]).text_chunks(batch, most=step))
    rows = fill_middle.fill_in_middle(documents(spark, texts, ids))
    got = sorted((str(r["doc_id"]), *map(str, (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]))) for r in rows.collect())
    assert got == sorted((str(i), *map(str, plain_fim(i, t))) for i, t in zip(ids, texts))
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    told = sorted((str(r["doc_id"]), r["restored_sha256"]) for r in fill_middle.digests(rows).collect())
    assert told == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip(ids, texts))
    assert fill_middle.fill_in_middle(nothing(spark)).count() == 0


# --- sharding of more bytes than a double can count


def test_cuts_are_exact_at_any_size(spark):
    random.seed(8)
    for total in (1, 997, 1 << 40, (1 << 53) + 1, 10**17 + 3):
        rows = [(s, z) for s, z in ((random.randrange(total), random.randrange(1, 10**6)) for _ in range(60))]
        rows += [(total * k // 8 + d, 2) for k in range(8) for d in (-2, -1, 0, 1) if total * k // 8 + d >= 0]
        got = spark.createDataFrame(rows, "start long, size long").select("start", "size", sharding.shard_of(F.col("start"), F.col("size"), total, 8).alias("shard")).collect()
        assert all(r["shard"] == min(7, (2 * r["start"] + r["size"]) * 8 // (2 * total)) for r in got)


def test_redaction_sorts_no_texts_and_leaves_plain_ones(spark):
    texts = ["nothing here", None, "", "to a@b.com and 10.0.0.1, a@b.com", "call +44 20 7946 0958 now", "no 1 or 2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.redact(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Union" in plan
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert [got[i] for i in range(3)] == texts[:3] and got[5] == texts[5] and len(got) == len(texts)
    assert got[3] == "to [email] and [ip], [email]" and got[4] == "call [phone] now"
