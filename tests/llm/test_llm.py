"""The training-data operators against brute force, on small rows; nulls, empty and long texts, ties and empty tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, components, decontaminate, html_extract, jaccard_join, pii, sentencepiece_codec, sharding, token_counts, token_output, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", None, "a", " two  spaces ", "line\nfeed\r\n\ttab", "Ünïcödé ▁ 中文 😀 İ", "x" * 5000, "word " * 3000, "<|endoftext|> it's 42!!", "12345678901234567890", "same", "same"]


def documents(spark, texts=ODD):
    rows = [(i, t, "en", f"clash{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, size string, row string")


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# --- sharding


def test_shards_are_even_and_whole(spark):
    random.seed(1)
    texts = ["ä" * random.randint(0, 900) for _ in range(300)] + [None, "", "z" * 20000]
    docs = documents(spark, texts)
    got = sharding.shard_by_bytes(docs.repartition(5), 8).orderBy("doc_id").collect()
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert [r["size"] for r in got] == sizes and [r["text_crc32"] for r in got] == [zlib.crc32((t or "").encode()) for t in texts]
    start, total = 0, sum(sizes)
    for r, s in zip(got, sizes):
        assert r["shard"] == min(7, (2 * start + s) * 8 // (2 * total))
        start += s
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(v == list(range(len(v))) for v in slots.values())
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_shards_with_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (1, "ccc")], "doc_id long, text string")
    got = sharding.shard_by_bytes(docs, 2).collect()
    assert len(got) == 4 and sum(r["size"] for r in got) == 10
    assert sharding.shard_by_bytes(nothing(spark)).count() == 0


# --- token files


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    data = token_output.write_token_files(docs.repartition(3), WORDS)
    got = token_output.read_token_files(data, with_ids=True).orderBy("doc_id").collect()
    library, start = Tokenizer.from_file(WORDS), 0
    for row, text in zip(got, ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (row["start"], row["n_tokens"], row["ids"]) == (start, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(ODD)
    dictionary = bytes(data.dictionary.first()["content"])
    blob = bytes(data.files.first()["blob"])
    one = token_output.ShardFile(blob, dictionary)
    assert one.ids(0)[-1] == 1
    with pytest.raises(ValueError):
        token_output.ShardFile(blob, dictionary + b"x")
    assert token_output.read_token_files(token_output.write_token_files(nothing(spark), WORDS)).count() == 0


def test_word_encoding_is_the_librarys():
    from tokenizers import Tokenizer

    random.seed(2)
    letters = "aAzZ09 \t\n'sSTtreveLLd.,!<|>endoftextÀÉßİıſÿŸǅȺɐѢΣσςĳ½²ª中文H̱e̊ ﬁ  \u0085\x1c_-#😀ａ"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    ids, offsets = token_output.encode_texts(pa.array(texts), WORDS, None)
    whole = Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in whole]


# --- SentencePiece


def test_sentencepiece_is_the_librarys(spark):
    library = sentencepiece_codec.codec(PIECES).library
    got = sentencepiece_codec.encode_documents(documents(spark), PIECES, outputs=("ids", "spans", "decoded", "digest")).orderBy("doc_id").collect()
    assert len(got) == len(ODD)
    for row, text in zip(got, ODD):
        ids, raw = library.encode(text or ""), (text or "").encode()
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and row["decoded"] == library.decode(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert row["starts"][:1] in ([], [0]) and (not ids or row["ends"][-1] == len(raw)) and row["starts"][1:] == row["ends"][:-1]
        for piece, a, b in zip(ids, row["starts"], row["ends"]):
            surface = library.id_to_piece(piece)
            if not library.is_byte(piece) and a:
                assert raw[a:b].decode() == surface.replace("▁", " ") or "▁" in (text or "")
    again = sentencepiece_codec.decode_documents(spark.createDataFrame([(1, library.encode("a b")), (2, None)], "doc_id long, ids array<int>"), PIECES).collect()
    assert [r["decoded"] for r in again] == ["a b", ""]
    assert sentencepiece_codec.encode_documents(nothing(spark), PIECES).count() == 0


def compiled_map(rules):
    """A double-array trie with the rules, as a model would hold it."""
    blob, values = b"", {}
    for key, value in sorted(rules.items()):
        values[key.encode()] = len(blob)
        blob += value.encode() + b"\0"
    nodes = {b""}
    for key in values:
        nodes |= {key[:i] for i in range(len(key) + 1)}
    units, used, base = {}, {0}, {}

    def place(node, at):
        labels = sorted({n[len(node)] for n in nodes if len(n) == len(node) + 1 and n.startswith(node)} | ({0} if node in values else set()))
        if not labels:
            return
        offset = next(o for o in range(1, 1 << 14) if all((at ^ o ^ c) not in used for c in labels))
        base[node] = offset
        used.update(at ^ offset ^ c for c in labels)
        units[at] = units.get(at, 0) | offset << 10 | (1 << 8 if node in values else 0)
        for c in labels:
            child = at ^ offset ^ c
            if c == 0 and node in values:
                units[child] = values[node] | 1 << 31
            else:
                units[child] = c
                place(node + bytes([c]), child)

    place(b"", 0)
    table = [units.get(i, 0x7F) for i in range(max(used) + 1)]
    return struct.pack("<I", 4 * len(table)) + struct.pack(f"<{len(table)}I", *table) + blob


def test_longest_prefix_normalisation_keeps_places():
    class Spec:
        precompiled_charsmap = compiled_map({"ﬁ": "fi", "A": "a", "AB": "x", "\t": " "})
        escape_whitespaces = add_dummy_prefix = remove_extra_whitespaces = True

    own = sentencepiece_codec.Normalizer(Spec)
    normal, align = own.normalize("  ABAﬁ\t é  ")
    assert normal.decode() == "▁xafi▁é"
    assert align.tolist() == [2, 2, 2, 2, 4, 5, 5, 8, 8, 8, 10, 11, 12]
    assert own.normalize("   ")[0] == b""


# --- token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts_add_up(spark, rule):
    encoding, _ = token_counts._encoding(RANKS, public_tokenizers.PATTERN)
    got = token_counts.attribute_tokens(documents(spark), RANKS, public_tokenizers.PATTERN, rule=rule).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert set(by) == set(range(len(ODD)))
    for i, text in enumerate(ODD):
        rows = sorted(by[i], key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in rows) == len(encoding.encode_ordinary(text or ""))
        assert [(text or "")[r["start_char"] : r["end_char"]] for r in rows] == ((text or "").replace("\n", "\n\0").split("\0") if not (text or "").endswith("\n") else None)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts_are_the_tokens(spark, rule):
    """Each token by hand: its bytes, the lines that they lie in, and the line that the rule gives it."""
    random.seed(6)
    letters = ["word ", "\n", "\n\n", "  \n", "é", "中文", "😀", "\t", "x" * 20, "it's", "42", "\r\n", " "]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(60)]
    encoding, _ = token_counts._encoding(RANKS, public_tokenizers.PATTERN)
    docs = spark.createDataFrame([*enumerate(texts), (None, "null id\nhere")], "doc_id long, text string")
    got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in token_counts.attribute_tokens(docs, RANKS, public_tokenizers.PATTERN, rule=rule).collect()}
    want = {}
    for i, text in [*enumerate(texts), (None, "null id\nhere")]:
        raw, line, of = text.encode(), 0, []
        for byte in raw:
            of.append(line)
            line += byte == 10
        lines = max(of, default=0) + 1
        counts, crossing, at = [0] * lines, [0] * lines, 0
        for token in encoding.encode_ordinary(text):
            own = of[at : at + len(encoding.decode_single_token_bytes(token))]
            at += len(own)
            chosen = own[0] if rule == "start" else own[-1] if rule == "end" else max(sorted(set(own)), key=own.count)
            counts[chosen] += 1
            crossing[chosen] += own[0] != own[-1]
        want |= {(i, k): (counts[k], crossing[k]) for k in range(lines)}
    assert got == want


def test_crossing_tokens():
    ends, starts = np.array([3, 8, 9]), np.array([0, 4, 5])
    assert token_counts.allocate(ends, starts, "start").tolist() == [0, 0, 2]
    assert token_counts.allocate(ends, starts, "end").tolist() == [0, 2, 2]
    assert token_counts.allocate(ends, starts, "most").tolist() == [0, 2, 2]


def test_field_counts(spark):
    df = spark.createDataFrame([(1, ["hello wor", "", None, "ld again"]), (2, [])], "doc_id long, parts array<string>")
    got = token_counts.attribute_tokens(df, RANKS, public_tokenizers.PATTERN, fields_col="parts").orderBy("doc_id", "section").collect()
    assert [r["n_chars"] for r in got] == [9, 0, 0, 8, 0] and [r["n_tokens"] for r in got] == [2, 0, 0, 1, 0] and got[0]["n_crossing"] == 1


# --- Jaccard join


def links_by_brute_force(texts, k, num, den):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for t in texts:
        w = [x for x in re.split("[ \t-\r]+", (t or "").translate(lower)) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n = [0] * len(sets)
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and den * len(x & sets[j]) >= num * len(x | sets[j]):
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), root(i), n[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_jaccard_components(spark, monkeypatch, k, num):
    random.seed(k)
    base = [" ".join(f"w{random.randint(0, 400)}" for _ in range(random.randint(20, 120))) for _ in range(6)]
    texts = [*base, "One two", "one TWO", "one", None, "", " \t", *base[:2]]
    for _ in range(140):
        words = random.choice(base[:4]).split()
        for _ in range(random.randint(0, 3)):
            words[random.randrange(len(words))] = f"n{random.randint(0, 9)}"
        texts.append(" ".join(words))
    expected = links_by_brute_force(texts, k, num, 100)
    for most in (1024, 16):  # one block a family, then many blocks
        monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", most)
        got = jaccard_join.jaccard_components(documents(spark, texts), k, num, 100).orderBy("doc_id").collect()
        assert [(r["n_shingles"], r["component_id"], r["n_links"]) for r in got] == expected
    kept = {r["doc_id"] for r in jaccard_join.keep_one(documents(spark, texts), k, num, 100).collect()}
    assert kept == {i for i, (_, c, _) in enumerate(expected) if c == i}


def test_jaccard_of_null_and_repeated_ids(spark):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    near = lambda i: base[i] + " end"
    rows = [(5, base[0]), (None, near(0)), (None, base[1]), (None, near(1)), (7, near(1)), (9, base[2]), (9, base[2]), (9, base[3]), (11, near(3)), (None, base[4]), (None, base[4]), (12, None), (12, ""), (None, " "), (13, base[5])]
    docs = spark.createDataFrame([(a, b, f"extra{i}") for i, (a, b) in enumerate(rows)], "doc_id long, text string, key string")
    links = links_by_brute_force([t for _, t in rows], 4, 85, 100)
    group = defaultdict(list)
    for (i, _), (_, root, _) in zip(rows, links):
        group[root].append(i)
    low = {root: min((i for i in ids if i is not None), default=None) for root, ids in group.items()}
    want = sorted((str(i), n, str(low[root]), k) for (i, _), (n, root, k) in zip(rows, links))
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in got) == want
    kept = jaccard_join.keep_one(docs, 4, 85, 100)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["5", "7", "9", "9", "None", "12", "12", "None", "13"])


def test_jaccard_of_nothing(spark):
    assert jaccard_join.keep_one(nothing(spark)).count() == 0
    assert jaccard_join.jaccard_components(nothing(spark)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (4, 1)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    assert len({got[i] for i in (1, 2, 3, 4)}) == 1 and len({got[i] for i in (7, 8, 9)}) == 1 and len(set(got.values())) == 3


# --- toxicity


def test_toxicity_learns_from_its_folds_only(spark):
    random.seed(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("rn", "st", "lm", "nd", "ck")]
    words_by_rank = [x + y for x in vocabulary for y in vocabulary]
    random.shuffle(words_by_rank)
    shares = [1 / (rank + 10) for rank in range(len(words_by_rank))]  # few words are common and most are rare, as in text
    letters = "abcdefghijklmnopqrstuvwxyz"
    bad = ["".join(random.choice(letters) for _ in range(7)) for _ in range(6)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = random.choices(words_by_rank, shares, k=random.randint(12, 90))
        for _ in range(3 if toxic else 0):
            words[random.randrange(len(words))] = random.choice(bad)
        held = zlib.crc32(str(i).encode()) % 4 == 2
        rows.append((i, " ".join(words).capitalize()))
        labels.append((i, int(toxic) if not held else int(not toxic)))  # wrong labels must not be read
    rows += [(1000, None), (1001, ""), (1002, "!!"), (1002, "!!"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, known).collect()
    assert len(got) == len(rows)
    right = [(r["predicted"] == 1) == (r["doc_id"] % 5 == 0) for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(right) / len(right) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit("own")), known)
    assert kept.columns == ["doc_id", "text", "score"] and kept.where("doc_id = 1002").count() == 2
    assert toxicity.score_toxicity(docs.limit(0), known).count() == 0 and toxicity.score_toxicity(docs, known.limit(0)).count() == len(rows)


def test_toxicity_is_calibrated_to_the_share_of_all_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 200)
    monkeypatch.setattr(toxicity, "SAMPLE_ORDINARY", 200)
    random.seed(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("rn", "st", "lm", "nd", "ck")]
    letters = "abcdefghijklmnopqrstuvwxyz"
    bad = ["".join(random.choice(letters) for _ in range(7)) for _ in range(6)]
    rows, labels, mild = [], [], set()
    for i in range(4000):
        toxic = i % 10 == 0
        n = random.choice((1, 8)) if toxic else int(random.random() < 0.2)  # one such word says toxic in a balanced sample only
        words = [random.choice(vocabulary) + random.choice(vocabulary) for _ in range(20)]
        for place in random.sample(range(20), n):
            words[place] = random.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
        if n == 1 and not toxic:
            mild.add(i)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = [r for r in toxicity.score_toxicity(docs, known).collect() if r["held_out"]]
    flagged = [r["predicted"] for r in got if r["doc_id"] in mild]
    assert len(flagged) > 100 and sum(flagged) < 0.1 * len(flagged)
    caught = [r["predicted"] for r in got if r["doc_id"] % 10 == 0]
    assert sum(caught) > 0.35 * len(caught)


def test_toxicity_reads_words_whole_and_every_script():
    find = toxicity.Coder().find
    assert find("hello wörld_x 中文字abc ひら 123 !!! 😀😀") == ["hello", "wörld", "_", "x", "中", "文", "字", "abc", "ひ", "ら", "123", "!!!", "😀", "😀"]
    coder = toxicity.Coder()
    assert len(set(coder.codes("abcdefghij abcdefghik " + "x" * 5000 + " " + "x" * 5001))) == 4
    random.seed(11)
    plain = "的一是不了人我在有他这中大来上个国到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后"
    samples, toxic = [], []
    for i in range(600):
        signs = [random.choice(plain) for _ in range(60)]
        if i % 3 == 0:
            for place in random.sample(range(60), 4):
                signs[place] = random.choice("滚蛋🤬💩")
        samples.append(coder.distinct("".join(signs)))
        toxic.append(int(i % 3 == 0))
    scorer = toxicity.dictionaries(samples, toxic).scorer()
    bad, good = plain[:20] + "滚蛋🤬💩" + plain[20:40], plain[:44]
    assert max(scorer.gains(bad)) > max(scorer.gains(good)) and scorer.features("")[1:] == [0.0] * 4


def test_toxicity_scores_by_compressed_lengths(spark):
    """The features and the score again, plainly: each window compressed by itself under either dictionary."""
    import zstandard
    from xxhash import xxh64_digest

    random.seed(12)
    words = [a + b for a in ("ba", "do", "ki", "lu", "ne") for b in ("rt", "sm", "nd", "lk", "st")]
    texts = [" ".join(random.choices(words, k=random.randint(1, 200))) + random.choice(("", " vile!", " 7 vile 7")) for _ in range(60)]
    coder = toxicity.Coder()
    model = toxicity.dictionaries([coder.distinct(t) for t in texts], [int("vile" in t) for t in texts])
    model.weights = [-2.0, 0.5, 0.25, 1.0, -0.1]
    rules = zstandard.ZstdCompressionParameters(window_log=20, hash_log=20, chain_log=20, search_log=3, min_match=6, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False)

    def length(data, content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(compression_params=rules, dict_data=held).compress(data))

    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(documents(spark, texts), model=model).collect()}
    ids = {r["text"]: r["doc_id"] for r in documents(spark, texts).collect()}
    for text in texts:
        codes = [xxh64_digest(w) for w in re.findall(toxicity.WORD, text.lower())]
        windows = [b"".join(codes[a : a + toxicity.WINDOW]) for a in range(0, len(codes), toxicity.WINDOW)]
        gains = [length(w, model.ordinary) - length(w, model.toxic + model.ordinary) for w in windows]
        n = len(gains)
        x = [1.0, sum(g for g in gains if g > 0) / n**0.5 / 4, sum(gains) / n, max(gains) / 8, np.log1p(n)]
        z = sum(w * v for w, v in zip(model.weights, x))
        assert abs(got[ids[text]] - 1 / (1 + np.exp(-z))) < 1e-12


# --- HTML


def test_main_text():
    page = """<!doctype html><title>t</title><script>var a="</p><article>";</script><nav><ul><li><a href=x>Menu</a><li>More</ul></nav>
    <div class="ad banner">Buy &amp; go</div><article><header><h1>The  head</h1></header><p>One<b> bold</b> &lt;text&gt;.<br>Next<p>Two is here too.
    <aside>See also</aside><form>Mail <input></form><div class="comments"><p>I do not agree with this at all, said someone.</p></div></article><footer>&copy; Me</footer>"""
    weights = html_extract.fit([page] * 5)
    assert html_extract.main_text(page, weights) == "The head\nOne bold <text>. Next\nTwo is here too."
    assert html_extract.main_text("<article><p>cut <a href=", weights) == "cut" and html_extract.main_text("", weights) == ""


def test_minimum_cut_is_minimal():
    random.seed(4)
    for _ in range(200):
        n = random.randint(1, 7)
        a, b = np.random.default_rng(random.randint(0, 9**9)).random((2, n)) * 3
        edges = {(i, j): random.random() * 2 for i in range(n) for j in range(i + 1, n) if random.random() < 0.6}
        cost = lambda side: sum(b[i] if s else a[i] for i, s in enumerate(side)) + sum(w for (i, j), w in edges.items() if side[i] != side[j])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(a, b, edges)) == pytest.approx(best)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<main><p>Hello there, this is a text.</p></main>", 5), (2, None, None, 6), (2, None, "", 6)], "page_id long, url string, html string, n_chars int")
    got = html_extract.extract_main_text(pages).orderBy("page_id").collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("Hello there, this is a text.", 28), ("", 0), ("", 0)]
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


# --- ANN


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.4, (150, 8)) for c in np.eye(8)[:6] * 2]).astype("float32")
    x[100:140] = x[100]  # copies
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2001, [0.0] * 8, 0), (2002, [None] * 8, 0), (2003, [float("nan")] * 8, 0), (2004, [float("inf")] * 8, 0), (2005, [], 0), (None, [1.0] * 8, 0)]
    monkeypatch.setattr(ann, "BLOCK", 100)
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).collect()
    by = defaultdict(dict)
    for r in got:
        by[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    v, hits, ties = x.astype(float), 0, 0
    assert set(by) == set(range(0, 900, 20))
    for q, found in by.items():
        score = v @ v[q]
        assert sorted(found) == list(range(1, 21))
        want = [i for i in np.lexsort((np.arange(900), -np.round(score, 12))) if i != q][:20]
        hits += len({i for i, _ in found.values()} & set(want))
        listed = [found[r] for r in range(1, 21)]
        assert all(abs(score[i] - s) < 1e-12 and i != q for i, s in listed) and listed == sorted(listed, key=lambda t: (-t[1], t[0]))
        ties += found[1][1] == found[2][1]
    assert hits / (20 * len(by)) >= 0.9 and ties
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 0.5)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_come_by_routing(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 1500)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.25, (100, 16)) for c in rng.normal(size=(20, 16)) * 2])
    x[:700] = x[0]  # a third of the rows are copies of one vector
    rows = [(20 * i, v.tolist()) for i, v in enumerate(x)]  # every row asks
    routers, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: routers.append(fit(*a)) or routers[-1])
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r["score"])
    assert len(by) == len(x) and all(len(scores) == 20 for scores in by.values())
    assert 10 < routers[0].parts and routers[0].visits < routers[0].parts / 2
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    best = -np.sort(-score, axis=1)[:, :20]
    reached = [np.mean(np.array(sorted(by[20 * i], reverse=True)) >= best[i, 19] - 1e-9) for i in range(len(x))]
    assert np.mean(reached) >= 0.9 and np.mean(reached[700:]) >= 0.9


def test_shorter_vectors_are_padded(spark):
    got = ann.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, [0.0, 1.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 3.0), (2, 2.0)]


def test_parts_are_balanced():
    x = np.random.default_rng(6).normal(size=(600, 8))
    part = ann.balanced_parts(x, ann.neighbour_lists(x, x, 10, np.arange(600)), 6)
    assert np.bincount(part, minlength=6).max() <= 106


# --- decontamination

ITEM = "A train leaves the old station at 60 kmh and after 3 hours Alice meets Bob who paid 12 dollars to Alice for the ticket"


def test_reworded_questions_are_found(spark):
    items = spark.createDataFrame([(1, ITEM, "x"), (2, "What is two plus two", "x"), (3, None, "x"), (4, "...", "x")], "item_id int, text string, doc_id string")
    asked = "a train leaves the old station at 75kmh and after 5 hours Carol meets Dave who paid 9.5 euros to {} for the ticket"
    texts = [f"hello. {asked.format('Carol')}, ok", asked.format("Erin"), "say: what is TWO plus two?", None, "", "what is two plus three", f"### {ITEM.upper()} ###", f"{ITEM} and more " * 2, "the old station at 60 kmh " * 3]
    got = decontaminate.find_contamination(documents(spark, texts), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(0, 1), (2, 2), (7, 1)} and not {r["doc_id"] for r in got} & {1, 3, 4, 5, 8}
    assert next(r for r in got if r["doc_id"] == 0)["reworded"] and not next(r for r in got if r["doc_id"] == 7)["reworded"]
    kept = decontaminate.drop_contaminated(documents(spark, texts), items)
    assert {1, 3, 4, 5, 8} <= {r["doc_id"] for r in kept.collect()} and kept.columns == documents(spark).columns
    assert decontaminate.find_contamination(nothing(spark), items).count() == 0 and decontaminate.find_contamination(documents(spark), items.limit(0)).count() == 0


def test_verbatim_copies_are_found_in_any_case_and_spacing(spark):
    long = "How far does Anna Smith of Old Town walk when she goes to Bergen and back with Carl Jones"
    items = spark.createDataFrame([(1, "What is 2 plus 2"), (2, "What is two plus two"), (3, "Ask Ann Lee"), (4, long), (5, "7 8 9 10 11 12 13 14 15 16"), (6, "What costs 3 apples and pears today")], "item_id int, text string")
    texts = ["so what is 2 plus 2 then", "Q: What is two plus two", "please ASK\n ann  LEE", long.upper(), long.replace(" ", "  \n"), "count 7 8 9 10 11 12 13 14 15 16", "Q: What costs 5 apples and pears today", "what is 2 plus 3", "7 9 8 10 12 11 14 13 16 15"]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(documents(spark, texts), items).collect()}
    assert got == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 4), (5, 5), (6, 6)}


def test_names_are_marked_after_any_white_space(spark):
    texts = ["at the Bergen quay, Ann\tBo X Yy Z", ("at the Bergen quay, Ann\tBo X Yy Z").replace(" ", " " * 40).replace("\t", "\n" * 5000)]
    one, wide = (r["t"] for r in decontaminate.template_words(documents(spark, texts)).orderBy("doc_id").collect())
    assert one == wide and one.count(decontaminate.NAME) == 4


def test_template_words_stay_in_step(spark):
    texts = [*ODD, ITEM, "3.5kg,4%;7:30 Mr Smith's 2nd 10,000 l", "É À Ça Va"]
    got = decontaminate.template_words(documents(spark, texts)).selectExpr("size(t) = size(r) as same").collect()
    assert all(r["same"] for r in got)


# --- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def passes(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = sorted((m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(kind, m.group()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)


def test_base_spans_are_the_patterns(spark):
    random.seed(7)
    parts = ["a@b.c", "a.b@c-d.e_f@g.h", "@", "x@y..z", "1.2.3.4", "001.2.3.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "+1 2 3)4.5-6 7 8 9 0", "é", "😀", " ", "\n", "9" * 13, "token = \"0123456789abcdef0123456789abcdef\"", "+", "0" * 16]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(400)]
    texts += [None, "", "a." * 20000, "1 " * 20000, "1.2.3.4 " * 300, "x@y.zz " * 200]
    got = pii.find_pii(documents(spark, texts)).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for row, text in zip(got, texts):
        want = base_spans(text)
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PLAIN] == [want.count(k + ":") for k in PLAIN]
        assert set(filter(None, want.split(","))) <= set(row["spans"].split(","))
    assert pii.find_pii(nothing(spark)).count() == 0


def test_boosted_trees_separate():
    vector = lambda **v: {f: v.get(f, 0) for f in pii.BINS}
    counts = [(vector(kind=2, digits=4), 1, part, 90) for part in (0, 1)] + [(vector(kind=2, digits=1), 0, part, 90) for part in (0, 1)]
    model = pii.fit(counts)
    assert model.raw(vector(kind=2, digits=4)) > 1 > -1 > model.raw(vector(kind=2, digits=1)) and model.least > 0.5
    assert pii.fit([c for c in counts if c[2] == 0]).least == pii.PRECISION


@pytest.mark.parametrize("n", [50, 3000])
def test_planted_loose_data_is_found_at_any_size(spark, n):
    random.seed(n)
    words = lambda k: " ".join(random.choice(["lorem", "ipsum", "dolor", "sit", "amet", "chapter", "version"]) for _ in range(k))
    key = "".join(random.choice("0123456789abcdef") for _ in range(208))
    late = "qwertyuiopasdfghjklzxcvbnmQWERTYUIOPASDFGHJKLZXCVB7kX2"
    planted = {"loose_email": "tom.hale (at) inbox.io", "loose_phone": "(415) 701-2266", "loose_card": "5105.1051.0510.5100", "secret": key}
    assert not {span for sides in pii.EXAMPLES.values() for side in sides for _, span, _ in side} & set(planted.values())
    texts = [words(20) + " 2024-01-05 and 1234567890 then 1.2.3 or 9807915762804491 " + words(9) for _ in range(n)]
    for i, (kind, span) in enumerate(planted.items()):
        texts[i * 5] = f"{words(9)} {span} {words(5)}"
    texts[25] = f'{words(3)} token = "{late}" {words(3)}'
    texts[26] = f'{words(3)} token = "{key[:40]}" {words(3)}'
    got = {r["doc_id"]: r for r in pii.find_pii(documents(spark, texts)).collect()}
    for i, (kind, span) in enumerate(planted.items()):
        at = texts[i * 5].index(span)
        assert got[i * 5]["spans"] == f"{kind}:{at}:{at + len(span)}"
    for i, span in ((25, late), (26, key[:40])):
        at = texts[i].index(span)
        assert got[i]["spans"] == f"secret:{at}:{at + len(span)}" and got[i]["n_secret"] == got[i]["n_spans"] == 1
    others = [i for i in range(n) if i not in (0, 5, 10, 15, 25, 26)]
    assert all(got[i]["spans"] == "" for i in others)


def test_added_spans_are_those_the_trees_select(spark):
    random.seed(9)
    parts = ["tel (415) 701-2266", "x at y dot org", "a@b", "4111.1111.1111.1111", "4111.1111.1111.1112", "1.2.3.4.5", "key=0a1b2c3d4e5f60718293a4b5c6d7e8f9", "1234567890123456", "j.r@m.org", "+1 (555) 010-9999", "some_long_variable_name_2", "version 1.2.3", "é", "12345678"]
    texts = [" ".join(random.choice(parts) for _ in range(random.randint(0, 6))) for _ in range(120)]
    docs = documents(spark, texts)
    found = pii.candidates(docs)
    part = F.pmod(F.xxhash64("m"), F.lit(2)).cast("int").alias("part")
    loose = pii.features(found.select("doc_id", "row", F.explode("loose").alias("x")).select("doc_id", "row", "x.*")).select("*", part)
    model = pii.fit_candidates(loose)
    base = {r["doc_id"]: [(x["start"], x["end"]) for x in r["base"]] for r in found.collect()}
    chosen = defaultdict(set)
    for r in loose.collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["m"]
        one = model[r["kind"]]
        score, least = 1 / (1 + np.exp(-one.raw({f: r[f] for f in pii.BINS}))), one.least
        if least is not None and score >= least - 1e-9 and not any(a < r["end"] and r["start"] < b for a, b in base[r["doc_id"]]):
            chosen[r["doc_id"]].add(f"{pii.KINDS[r['k']]}:{r['start']}:{r['end']}")
    got = {r["doc_id"]: set(filter(None, r["spans"].split(","))) - set(base_spans(texts[r["doc_id"]]).split(",")) for r in pii.find_pii(docs).collect()}
    assert any(chosen.values()) and got == {i: chosen[i] for i in range(len(texts))}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "write a@b.cc or +1 (555) 010-9999.", 7, "z"), (2, None, 0, "z"), (3, "clean", 5, "z")], "doc_id long, text string, n_chars long, row string")
    got = pii.redact(docs).orderBy("doc_id").collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("write [email] or [phone].", 25), (None, None), ("clean", 5)] and pii.redact(docs).columns == docs.columns


# --- pipeline


def test_pipeline_stages_follow_each_other(spark):
    import os

    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    last = corpus_pipeline.run(spark, folder).collect()
    kept = [r["doc_id"] for r in last]
    assert len(kept) == len(set(kept)) and set(kept) < before
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    survivors = [i for i in sorted(before) if i in set(kept)]
    assert len({c for _, c, _ in links_by_brute_force([texts[i] for i in survivors], 5, 80, 100)}) == len(survivors)
    library = sentencepiece_codec.codec(PIECES).library
    clean = [r for r in last if not re.search(r"[0-9@]", texts[r["doc_id"]])]
    assert clean and all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in clean)


def test_stages_keep_odd_rows(spark):
    rows = [(None, None, "en", "s", 0), (None, "", "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "some plain words " * 5, "en", "s", 85), (3, "some plain words " * 5, "en", "s", 85)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for empty in (False, True):
        given = docs.limit(0) if empty else docs
        stages = [toxicity.drop_toxic(given, labels), jaccard_join.keep_one(given), decontaminate.drop_contaminated(given, items), pii.redact(given)]
        for frame, lost in zip(stages, (0, 1, 0, 0)):
            assert frame.columns == docs.columns and frame.count() == (0 if empty else len(rows) - lost)


def test_pipeline_decides_as_its_operators(spark):
    """Each stage against a plain reading of what the one before kept."""
    import os

    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    read = lambda frame: {r["doc_id"]: r["text"] for r in frame.collect()}
    clean = read(stage["toxicity"](spark, docs, folder))
    predicted = {r["doc_id"] for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert clean == {i: t for i, t in held.items() if i not in predicted}
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = read(stage["benchmark decontamination"](spark, docs, folder))
    for i, text in held.items():
        words = " ".join(re.findall(r"\w+", (text or "").lower()))
        if any(item and item in words for item in items):
            assert i not in kept
    redacted = read(stage["PII"](spark, docs, folder))
    for i, text in redacted.items():
        spans = base_spans(held[i])
        assert (text == held[i]) <= (spans == "")
        for span in filter(None, spans.split(",")):
            _, a, b = span.split(":")
            assert held[i][int(a) : int(b)] not in text or held[i].count(held[i][int(a) : int(b)]) > spans.count(",") + 1
