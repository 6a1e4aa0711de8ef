"""Small fixtures against brute force: nulls, empty, very long and repeated texts, ties, empty tables, clashing columns."""

import base64
import hashlib
import json
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelweave.llm import bpe, common, fingerprint, language, license, minhash, mixing, quality, recordfile, search, warc
from panelweave.llm.components import connected_components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) with columns whose names operators also use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA).withColumns({"key": F.lit("x"), "size": F.lit(1), "n": F.lit(2), "component": F.lit(3)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, num, den):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {d: (len(s), root(d)) for d, s in sets}


def near_corpus(seed=0, groups=6, copies=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(40, 120))]
        texts.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += ["", None, "one two", "ONE  two", "A b c d e", "a B c\td e", texts[0].upper()]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("plain", [0, 24])
@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, plain, num, den):
    monkeypatch.setattr(minhash, "PLAIN", plain)  # 0: all open buckets go by differences
    rows = near_corpus(seed=num, copies=30)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, rows), num, den).collect()}
    assert got == brute_components(rows, num, den)


def family(r, members, words=120):
    """Texts around one base: edits in few places, cut copies, a variant that many share."""
    base = [f"w{i}" for i in range(words)]
    yield " ".join(base)
    for _ in range(members):
        w = base[: r.choice([80, 92, 93, 120, 120, 120])] + [f"t{r.randrange(3)}x{j}" for j in range(r.choice([0, 0, 3, 12]))]
        if r.random() < 0.3:
            w[10:25] = [f"v{j}" for j in range(15)]
        for _ in range(r.choice([0, 1, 3, 5])):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        yield " ".join(w)


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5)])
def test_consensus_candidates_connect_all_links(spark, num, den):
    r = random.Random(num)
    rows = list(enumerate([*family(r, 90), *(" ".join(x) for x in [["q"], ["one", "two"]])]))
    sets = {d: shingles(t) for d, t in rows}
    linked = lambda a, b: den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    want = {d: c for d, (_, c) in brute_components(rows, num, den).items()}
    docs = documents(spark, rows)
    nodes = minhash.signatures(docs, 5, 4, 6).selectExpr("doc_id as node", "doc_id as rep", "fp1")
    # one group of all texts, each of a label of its own, and one in which half the labels are known
    for known in ({}, {d: c for d, c in want.items() if d % 2}):
        members = spark.createDataFrame([(g, d, known.get(d, d)) for g in (0, 7) for d in sets], "g long, m long, label long")
        groups = spark.createDataFrame([(0, len(rows)), (7, len(rows))], "g long, size long")
        found = {(x["a"], x["b"]) for x in minhash._around_consensus(docs, nodes, members, groups, 5, num, den).collect()}
        edges = [(a, b) for a, b in found if linked(a, b)] + list(known.items())
        root = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
        assert {d: root.get(d, d) for d in sets} == want and len(set(want.values())) > 10


def test_large_near_copy_group(spark):
    r = random.Random(9)
    rows = list(enumerate([*family(r, 500, words=130), "", None]))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_components(rows, 4, 5)


def test_one_id_with_two_texts(spark):
    r = random.Random(2)
    base, other = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    near = lambda t: t + " " + r.choice("xyz")
    rows = [(5, base), (5, other), (5, other), (2, near(base)), (9, near(other)), (5, base + "  ")]
    got = sorted((x["doc_id"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == [(2, 2, True), (5, 2, False), (5, 2, False), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert sorted((x["doc_id"], x["text"]) for x in minhash.deduplicate(documents(spark, rows)).collect()) == [(2, rows[3][1]), (5, other)]


def test_near_duplicates_cases(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    docs = documents(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A B C D E F"), (4, None), (5, "")])
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, None, None), (3, 3, True), (3, 3, True), (9, 3, False), (4, 4, True), (5, 5, True)], key=str)
    kept = sorted((r["doc_id"] for r in minhash.deduplicate(docs).collect()), key=str)
    assert kept == [3, 4, 5, None]
    assert minhash.deduplicate(docs).columns == docs.columns


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(0)
    sketch = minhash.FastSimilaritySketch(256)
    assert (sketch(np.array([7], np.uint64)) > 0).all()
    common_, a, b = (r.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 100, 100))
    agree = (sketch(np.concatenate((common_, a))) == sketch(np.concatenate((common_, b)))).mean()
    assert abs(agree - 600 / 800) < 0.12
    assert ((1 - 0.85**6) ** minhash.n_bands(85, 100, 6, 1e-8)) <= 1e-8


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_licence_scan_against_brute_force(spark):
    r = random.Random(1)
    words = [w for p in license.PHRASES for w in p.split()] + ["under", "The", "x1", "é"]
    rows = [(i, r.choice(["", "-", " "]).join([" "]) + " ".join(r.choice(words) + r.choice(["", ".", "-"]) for _ in range(r.randint(0, 40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "Mit\x00License " * 5000), (903, license.TEMPLATES["mit-text"][0].replace("without restriction", "with none"))]
    got = {x["doc_id"]: x for x in license.scan(documents(spark, rows)).collect()}
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        base = sorted((i, label) for p, label in license.PHRASES.items() for i in range(len(w)) if w[i : i + len(q := p.split())] == q)
        assert (got[d]["n_words"], got[d]["n_base"], got[d]["base_labels"]) == (len(w), len(base), ",".join(sorted({b for _, b in base})))
        assert (got[d]["first_word"], got[d]["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert set(filter(None, got[d]["base_labels"].split(","))) <= set(filter(None, got[d]["labels"].split(","))) and 0 <= got[d]["score"] <= 1
    assert "mit-text" in got[903]["labels"] and got[903]["score"] > 0.9
    assert license.scan(empty(spark)).count() == 0


def brute_spans(words, scanner, templates):
    """Maximal common runs by comparing every pair of places, and every chain of them."""
    out = []
    for label, texts in templates.items():
        share = lambda w: 1 / sum(any(w in license.tokens(t) for t in ts) for ts in templates.values()) ** 2
        for text in texts:
            t, runs = license.tokens(text), []
            for i in range(len(words)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                        n += 1
                    if n >= scanner.least and not (i and j and words[i - 1] == t[j - 1]):
                        runs.append((i, j, n))

            def chains(run):
                i, j, n = run
                yield n, i, set(range(j, j + n)), i + n
                for before in runs:
                    if before[0] + before[2] <= i and before[1] + before[2] <= j and i - before[0] - before[2] <= scanner.gap and j - before[1] - before[2] <= scanner.gap:
                        for c, s, held, _ in chains(before):
                            yield c + n, s, held | set(range(j, j + n)), i + n

            total = sum(map(share, t))
            for run in runs:
                for c, s, held, e in chains(run):
                    if c >= scanner.coverage * len(t) and sum(share(t[x]) for x in held) >= (scanner.short_coverage if len(t) <= scanner.short else scanner.coverage) * total - 1e-9:
                        out.append((label, s, e, c / len(t)))
    return out


def test_licence_chains():
    scanner = license.Scanner()
    labels = lambda t: {s.label for s in scanner(license.tokens(t))[1]}
    for text in ("licensed under the BSD License", "released under the title Blue", "This work is licensed under a Creative Commons licence", "under a Creative Commons licence", "this program is free software", "is licensed under the terms of the"):
        assert labels(text) == set()
    for label, texts in license.TEMPLATES.items():
        assert all(label in labels("x y " + t + " z") for t in texts)
    assert labels("The code is licensed under the terms of the MIT License.") == {"mit-notice"} and labels("Licensed under CC BY-SA 4.0") == {"cc-by-sa"}
    # distinct tokens in every template: chains can be compared one by one
    templates = {"a": (" ".join(f"a{i}" for i in range(30)),), "b": (" ".join(f"b{i}" for i in range(8)),)}
    scanner, r = license.Scanner(templates, {}), random.Random(3)
    for _ in range(200):
        words = []
        for _ in range(r.randint(1, 5)):
            label, size = r.choice([("a", 30), ("b", 8)])
            first = r.randrange(size - 3)
            words += [f"{label}{i}".encode() for i in range(first, r.randint(first + 3, size))] + [b"x"] * r.choice([0, 1, 5, 20])
        want, got = {}, {}
        for label, _, _, c in brute_spans(words, scanner, templates):
            want[label] = max(want.get(label, 0), c)
        for x in scanner(words)[1]:
            got[x.label] = max(got.get(x.label, 0), x.coverage)
        # runs may overlap in the scanner, so it may cover more, but no more than the longest common subsequence
        assert all(got.get(k, 0) >= c - 1e-9 for k, c in want.items())
        for label, c in got.items():
            t = license.tokens(templates[label][0])
            row = [0] * (len(t) + 1)
            for w in words:
                now = [0]
                for j, x in enumerate(t):
                    now.append(row[j] + 1 if w == x else max(row[j + 1], now[j]))
                row = now
            assert c * len(t) <= row[-1] + 1e-9


ODD = ["", None, " ", "\n\n x", "don't we'll I'M 's '", "a  b\t\nc ", "中文\U0001f600́ é²", "x" * 5000, "\x85　  z", "<|endoftext|> 12345 !!", "Ab" * 9 + "'re'd"]


def test_bpe_is_what_the_library_gives(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(0)
    texts = ODD + ["".join(r.choice(" \n'stredlmv19é中! ") for _ in range(r.randint(0, 30))) for _ in range(400)] + ["".join(chr(r.choice([r.randrange(0x3000), r.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(200)]
    docs = documents(spark, list(enumerate(texts)) + [(None, "x"), (0, "again")])
    vocabulary = bpe.load_ranks(path, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in bpe.with_ids(docs.where("text is null or text <> 'again'"), vocabulary).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == own.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()
    assert bpe.round_trip_digests(docs, vocabulary).count() == docs.count()
    row = bpe.round_trip_digests(docs.where("doc_id = 4"), vocabulary).first()
    assert row["ids_sha256"] == hashlib.sha256(np.array(own.encode_ordinary(texts[4]), "<u4").tobytes()).hexdigest()
    encoder = bpe.Encoder(vocabulary)
    assert "".join(texts[5][a:b] for a, b in encoder.offsets(texts[5])) == texts[5]
    with pytest.raises(ValueError, match="not cut by"):
        bpe.Vocabulary.from_ranks(path, r"\w+|\W+")
    # characters whose bytes are split over ids come back whole
    assert bpe.decode(np.array(own.encode_ordinary("\U0001f9ff"), np.uint32), vocabulary.tokens).decode() == "\U0001f9ff"


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    vocabulary = bpe.Vocabulary.from_json(path)
    texts = ODD * 3
    rows = [(7 * (i % 20) - 30, t) for i, t in enumerate(texts)] + [(None, "no id")]
    docs = documents(spark, rows)
    where = f"file://{tmp_path}/files"
    recordfile.write_token_files(docs, where, vocabulary, 2, file_bytes=4000)
    index = recordfile.read_index(spark, where).collect()
    assert len(list((tmp_path / "files" / "index").glob("*.parquet"))) >= 1 and len(list((tmp_path / "files" / "data").glob("part-*"))) > 3
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for d, t in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in index), key=lambda r: r[1]) == want
    row = next(r for r in index if r["doc_id"] == want[5][0])
    data = (tmp_path / "files" / "data" / row["file"]).read_bytes()
    some = recordfile.read_index(spark, where).where("offset % 3 = 0").orderBy(F.rand(1))
    got = {(x["file"], x["offset"]): (x["doc_id"], x["ids"]) for x in recordfile.read_at_offsets(spark, where, some.select("file", "offset")).collect()}
    assert len(got) == some.count() > 5
    for x in some.collect():
        assert got[x["file"], x["offset"]][0] == x["doc_id"] and zlib.crc32(np.array(got[x["file"], x["offset"]][1], "<u4").tobytes()) == x["ids_crc32"]
    assert recordfile.read_records(spark, where).count() == len(rows)
    one = documents(spark, [(5, f"{i:03d} text") for i in range(400)])  # one id for all rows
    recordfile.write_token_files(one, f"file://{tmp_path}/one", vocabulary, 2, file_bytes=500)
    assert recordfile.read_index(spark, f"file://{tmp_path}/one").select("file").distinct().count() > 3
    assert recordfile.read_at(data, row["offset"])[0] == row["doc_id"]
    broken = bytearray(data)
    broken[row["offset"] + 20] ^= 1
    with pytest.raises(recordfile.CorruptRecord):
        list(recordfile.frames(bytes(broken)))
    with pytest.raises(recordfile.CorruptRecord):
        list(recordfile.frames(data[:-3]))
    assert recordfile.token_file_digests(empty(spark), vocabulary).count() == 0
    other = json.loads(open(path).read()) | {"normalizer": {"type": "Lowercase"}}
    (tmp_path / "other.json").write_text(json.dumps(other))
    with pytest.raises(ValueError, match="pattern"):
        bpe.Vocabulary.from_json(str(tmp_path / "other.json"))


def test_added_tokens_are_what_the_library_gives():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, vocabulary = Tokenizer.from_file(path), bpe.Vocabulary.from_json(path)
    encoder = bpe.Encoder(vocabulary)
    r = random.Random(0)
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>", "<|ENDOFTEXT|>", "it'<|endoftext|>s  <|endoftext|>\n\n<|endoftext"]
    texts += ["".join(r.choice(["<|endoftext|>", " ", "  ", "'", "s", "é", "word", "12", "<|", "\n"]) for _ in range(20)) for _ in range(300)]
    for t, got in zip(texts, encoder(texts), strict=True):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids and bpe.decode(ids, vocabulary.tokens) == (t or "").encode()
    assert encoder.offsets("a<|endoftext|>") == [(0, 1), (1, 14)]


def test_archives_reject_magic_inside_payloads(spark, tmp_path, monkeypatch):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/ b\r\n", "x"), (5, None, "x"), (2, "u", None), (3, "u", ""), (4, "v", inner * 4), (6, "w", "WARC/1.0\r\n" * 50 + "é"), (7, "w", "tail WARC/1.0\r"), (None, "n", "x")]
    for i in range(10, 60):
        pages.append((i, "u", f"page {i} " * (i * 3) + inner))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        where = warc.write_warc(df.coalesce(2), f"file://{tmp_path}/w")
        assert warc._entries(spark, where).count() > 20  # many blocks a file
        got = {r["record_id"]: r for r in warc.read_warc(spark, where).collect()}
        monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
        again = {r["record_id"]: r for r in warc.read_warc(spark, where).collect()}
        assert again == got and warc.page_records(df).count() == len(pages)
        small = warc.read_warc(spark, warc.write_warc(df, f"file://{tmp_path}/g", least_bytes=2, compression="gzip")).where("record_type = 'revisit'").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(pages) and small == 0
    largest = {}
    for p, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if p is None else p)
    for p, _, h in pages:
        body = (h or "").encode()
        row = got[f"<urn:page:{'null' if p is None else p}>"]
        assert row["payload_bytes"] == len(body) and row["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (row["record_type"], row["refers_to"]) == (("response", None) if largest[h or ""] == p else ("revisit", f"<urn:page:{largest[h or '']}>"))
        assert row["record_type"] == "revisit" or bytes(row["payload"]) == body
    out = warc.page_records(df)
    with pytest.raises(Exception, match="no record's header"):
        broken = spark.createDataFrame([("WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nnothing\r\n",)], "value string")
        broken.coalesce(1).write.option("lineSep", "\n").text(f"file://{tmp_path}/b")
        warc.read_warc(spark, f"file://{tmp_path}/b").collect()
    assert out.count() == len(pages) and warc.page_records(df.limit(0)).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        level = left / sum(w[s] for s in names if s not in full) if len(full) < len(names) else 0
        more = {s for s in names if s not in full and w[s] * level > most * sizes[s]}
        if not more:
            return {s: float(most * sizes[s]) if s in full else w[s] * level for s in names}
        full |= more


def test_mix_reaches_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)) if i % 17 else None, "en", r.choice(["a"] * 10 + ["b", "c", "é", None, "tiny"])) for i in range(900)]
    rows += [(1000, "one", "en", "z"), (1000, "one", "en", "z"), (1001, "x " * 4000, "en", "huge"), (None, "no id", "en", "b"), (1002, "", "en", "void")]
    docs = documents(spark, rows).withColumns({c: F.lit("mine") for c in ("_source", "_order", "_copies", "id", "row", "slice", "copies", "taken", "time")})
    got = mixing.mix(docs.drop("taken")).collect()
    sizes, taken, target, largest = {}, {}, {}, {}
    for x in got:
        s = x["source"]
        sizes[s] = sizes.get(s, 0) + x["size"]
        taken[s] = taken.get(s, 0) + x["taken"]
        target[s], largest[s] = x["target"], max(largest.get(s, 0), x["size"])
        assert x["taken"] in [k * x["size"] for k in range(4)] and x["size"] == len((x["text"] or "").split()) and x["_order"] == x["row"] == "mine"
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s]
    # what is left is what the source of one long text lacks
    assert sum(sizes.values()) - (target["huge"] - taken["huge"]) - 5 <= sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect()
    assert sorted((str(x["doc_id"]), x["taken"]) for x in got) == sorted((str(d), t) for d, t in again)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(x["taken"] // x["size"] for x in got if x["size"])
    assert out.where("size <> 1 or _order <> 'mine' or taken <> 'mine'").count() == 0
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_mix_is_a_fair_queue(spark, monkeypatch):
    """Against a sequential queue over the same shuffled order, with slices and ranges of few rows."""
    monkeypatch.setattr(mixing, "SLICE", 20)
    monkeypatch.setattr(mixing, "RANGE", 20)
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randint(0, 9)), "en", r.choice(["a"] * 9 + ["b", None, "c"])) for i in range(300)]
    docs = documents(spark, rows)
    slices = -(-len(rows) // 20)
    order = {x["doc_id"]: x["o"] for x in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("o")).collect()}
    sizes = {s: sum(len(t.split()) for _, t, _, own in rows if own == s) for s in {x[3] for x in rows}}
    targets, queue = brute_targets(sizes), []
    for s in sizes:
        end = 0
        for p in range(3):
            for d, t in sorted(((d, t) for d, t, _, own in rows if own == s and t), key=lambda x: (order[x[0]] % slices, order[x[0]])):
                end += len(t.split())
                if end - len(t.split()) < targets[s]:
                    queue.append((end / targets[s], order[d], d, p, s, len(t.split())))
    left, copies, words = sum(sizes.values()), dict.fromkeys((x[0] for x in rows), 0), dict.fromkeys(sizes, 0)
    for _, _, d, _, s, size in sorted(queue):
        if size > left:
            break
        left, copies[d], words[s] = left - size, copies[d] + 1, words[s] + size
    for s in sorted(sizes, key=lambda s: (-(targets[s] - words[s]) / targets[s], "" if s is None else "=" + s)):
        fit = [(len(t.split()), order[d], d) for d, t, _, own in rows if own == s and t and copies[d] < 3 and len(t.split()) <= targets[s] - words[s]]
        if fit and targets[s] - words[s] >= 1:
            size, _, d = max(fit)
            if size > left:
                break
            left, copies[d] = left - size, copies[d] + 1
    got = {x["doc_id"]: x["taken"] // max(1, x["size"]) for x in mixing.mix(docs).collect()}
    assert got == copies


def test_search_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(r.randint(0, 25)))) for i in range(150)] + [(500, None), (501, "zz zz"), (502, "zz zz"), (None, "zz")]
    docs = documents(spark, rows)
    asked = spark.createDataFrame([(1, "a bb ccc"), (2, "zz"), (3, None), (4, ""), (5, "unknown"), (6, "A A b")], "query_id long, text string")
    got = [(x["query_id"], x["rank"], x["doc_id"], x["score"]) for x in search.search(docs.repartition(5), asked, k=7, block_bytes=64).orderBy("query_id", "rank").collect()]
    bags = [(d, (t or "").lower().split()) for d, t in rows]
    n, mean = len(bags), sum(len(b) for _, b in bags) / len(bags)
    want = []
    for q, t in [(1, "a bb ccc"), (2, "zz"), (6, "a b")]:
        scores = []
        for d, b in bags:
            s = 0
            for term in set(t.split()):
                df, tf = sum(term in x for _, x in bags), b.count(term)
                if tf:
                    s += round(float(np.log(1 + (n - df + 0.5) / (df + 0.5))) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean))) * 2**20)
            if s:
                scores.append((-s, d is None, d or 0, d))
        want += [(q, i + 1, d, -s / 2**20) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:7])]
    assert got == want
    assert search.search(empty(spark), asked).count() == 0 and search.search(docs, asked.limit(0)).count() == 0


def test_search_begins_with_thresholds_from_a_few_shards(spark, monkeypatch):
    """tasks don't each hand on their own k best; results are those of one shard, which has no such thresholds."""
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 2) for _ in range(r.randint(1, 25)))) for i in range(720)]
    docs = documents(spark, rows)
    asked = spark.createDataFrame([(i, t) for i, t in rows[:20]], "query_id long, text string")
    hits, keep = [], search.store

    def store(df, label):
        out = keep(df, label)
        if label == "hits":
            hits.append(out.count())
        return out

    monkeypatch.setattr(search, "store", store)
    find = lambda part: sorted(tuple(x) for x in search.search(part, asked, k=5).collect())
    want = find(docs.coalesce(1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert find(docs.repartition(36)) == want and len(want) == 100
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert hits[0] == 100 and hits[1] < 36 * 100 // 2


def test_fingerprints(spark):
    f = fingerprint.Fingerprinter()
    a, b, c = "first one two three\n", "second four five six\n", "third x"
    assert np.array_equal(f(a + b + c), f(b + "\n" + c + "\n" + a)) and not np.array_equal(f(a + b), f(a + a + b))
    assert np.array_equal(fingerprint.insert(f(a), f(b)), f(a + b)) and np.array_equal(fingerprint.delete(f(a + b + c), f(b)), f(a + c))
    assert np.array_equal(fingerprint.from_text(fingerprint.as_text(f(a))), f(a)) and fingerprint.likeness(f(""), f(None)) == 1.0
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)) for _ in range(40)] + ["", None, "x", "é\U0001f600y", texts_long := "lorem ipsum dolor " * 3000]
    rows = [(5 * i % 97, t) for i, t in enumerate(texts)]
    ordered = sorted(rows)
    got = {x["doc_id"]: x for x in fingerprint.edited_fingerprints(documents(spark, rows)).collect()}
    assert len(got) == len(rows) and texts_long
    for i, (d, t) in enumerate(ordered):
        t, n = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[d]["edited_fingerprint"] == fingerprint.as_text(f(e)) and got[d]["near_next"] == fingerprint.likeness(f(t), f(n))
        if len(t) == 1199 and len(n) > 1000 and "lorem" not in n:
            assert 0.25 < got[d]["near_edited"] < 0.75 and got[d]["near_next"] < 0.35
    assert fingerprint.edited_fingerprints(empty(spark)).count() == 0
    one = fingerprint.edited_fingerprints(documents(spark, [(1, "abcd")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    ties = fingerprint.edited_fingerprints(documents(spark, [(None, "n1"), (None, "n2"), (1, "b"), (1, "a"), (1, "a"), (2, "cc")]))
    assert ties.count() == 6 and ties.where("edited_sha256 = '" + hashlib.sha256(b"cn").hexdigest() + "'").count() == 1


def test_language(spark):
    r = random.Random(4)
    sound = {"aa": ["ba", "ka", "la"], "bb": ["zu", "vu", "xu"], "cc": ["до", "ми", "ла"]}
    rows = [(i, " ".join("".join(r.choice(sound[g]) for _ in range(3)) for _ in range(12)), g) for i in range(240) for g in [r.choice(list(sound))]]
    rows += [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, "zuvu " * 20000, None), (None, "baka", "aa")]
    docs = documents(spark, [(d, t, g) for d, t, g in rows])
    got = {x["doc_id"]: x for x in language.train_and_predict(docs, sample=60).collect()}
    for d, t, g in rows:
        x = got[d]
        assert x["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= x["score"] <= 1
        assert x["lang_pred"] == ("und" if not any(c.isalpha() for c in t or "") else "bb" if d == 903 else g)
    kept = language.select(docs, language.train(docs, 60))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    none = language.train_and_predict(documents(spark, [(1, "abc", None)])).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0) and language.train_and_predict(empty(spark)).count() == 0


def test_quality(spark):
    r = random.Random(6)
    word = lambda: r.choice(["the", "of", "and", "ran", "sun", "tree", "walk", "blue"])
    rows, labels = [], []
    for i in range(400):
        w, kind = [word() for _ in range(30)], i % 4
        if kind == 0:
            w = [x + "%%%" for x in w]
        if kind == 1:
            w[r.randrange(30)] = "nasty"
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    docs = documents(spark, [*rows, (900, None), (901, ""), (None, "the sun")])
    ratings = quality.grades_from_labels(spark.createDataFrame([*labels, (3, 1, 0), (5000, 1, 1), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int"))
    model = quality.train(docs.where("doc_id % 5 > 0"), ratings.where("doc_id % 5 > 0"))
    assert model.thresholds == tuple(sorted(model.thresholds)) and model.grades == (0, 1, 2)
    got = {x["doc_id"]: x for x in quality.score(docs, model).collect()}
    right = [(got[i]["p_top"] >= 0.5) == (i % 4 > 1) for i in range(0, 400, 5)]
    assert sum(right) >= 0.95 * len(right) and all(0 <= x["expected_grade"] <= 2 for x in got.values())
    own = docs.withColumns({"p_top": F.lit("mine"), "expected_grade": F.col("doc_id")})
    kept = quality.select(own, model)
    assert kept.columns == own.columns and kept.where("p_top <> 'mine' or expected_grade <> doc_id").count() == 0
    assert quality.score(own, model).where("p_top between 0 and 1").count() == docs.count()
    twice = quality.train(docs.where("doc_id % 5 > 0").union(docs.where("doc_id % 5 > 0")), ratings.where("doc_id % 5 > 0"))
    assert twice.thresholds == pytest.approx(model.thresholds, rel=1e-3)
    nothing = quality.train(docs, ratings.limit(0))
    assert quality.select(docs, nothing).count() == docs.count() and quality.score(empty(spark), model).count() == 0


def test_quality_fit_is_the_likelihood_minimum():
    """Against numeric gradients and a plain descent on the same penalised likelihood."""
    r = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        at = r.choice(np.arange(4, 10), 3, replace=False)
        x = r.random(3).astype(np.float32)
        s = float(x @ np.linspace(-3, 3, 6)[at - 4]) + r.logistic()
        rows.append((at, x, int(np.searchsorted([-1, 0.5, 2], s))))
    f = quality.objective(rows, 4, 10, 1e-2)
    start = r.normal(size=13)
    value, g = f(start)
    numeric = [(f(start + 1e-5 * e)[0] - f(start - 1e-5 * e)[0]) / 2e-5 for e in np.eye(13)]
    assert np.allclose(g, numeric, atol=1e-6)
    x = np.concatenate((np.zeros(10), [-1, 0, 0]))
    for _ in range(20_000):
        x = x - 0.5 * f(x)[1]
    model = quality.fit(rows, ridge=1e-2, evidence=0, bits=8)
    assert np.allclose(model.weights[4:10], x[4:10], atol=0.02) and np.allclose(model.thresholds, x[10] + np.cumsum([0, *np.exp(x[11:])]), atol=0.02)
    assert quality.losses(model, rows).mean() + 0.5e-2 * (model.weights**2).sum() <= f(x)[0] + 1e-4
    top = model.score(np.array([9]), np.array([50.0]))
    assert top[1] > 0.99 and 2.99 < top[0] <= 3


def test_shared_folder_comes_from_the_session(spark):
    assert common.work_path(spark, "x").startswith(common.shared_dir(spark))
