"""Each operator against a brute-force version, and on odd inputs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quorumlake.llm import bpe, common, decontaminate, exact, linededup, quality, secrets, simhash, suffix, toxicity, wordpiece
from quorumlake.llm.components import components
from quorumlake.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, row long, fp long, h long, row__ long, runs__ long, run_row__ long, stays__ long"


def table(spark, texts, start=0):
    """(doc_id, text) rows with extra columns whose names operators use inside."""
    rows = [(*(x if isinstance(x, tuple) else (start + i, x)), "en", "s", 1, 2, 3, 4, 5, 6, 7) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


LONG = "lorem ipsum dolor sit amet, consectetur " * 6000
ODD = [None, "", "   \n\t ", "one", "one", "two words", "naïve café 中文 🙂", "x" * 100_000, LONG, (7, "one"), (7, "one"), (None, "one")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def ranks():
    return bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def operators(spark):
    import public_tokenizers

    none = labels(spark, [])
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, "")], "item_id long, text string")
    return {
        "quality": (lambda d: quality.classify(d, quality.fit(d, none)), True),
        "leaks": (lambda d: decontaminate.leaks(d, items), False),
        "count_tokens": (lambda d: wordpiece.count_tokens(d, [b" one", b"o"]), True),
        "dedup_lines": (linededup.dedup_lines, True),
        "secrets": (lambda d: secrets.digests(secrets.scan(d, secrets.train(d))), True),
        "remove_repeats": (suffix.remove_repeats, True),
        "near_duplicates": (simhash.near_duplicates, True),
        "encode": (lambda d: bpe.encode_documents(d, ranks(), public_tokenizers.PATTERN), True),
        "encode_digests": (lambda d: bpe.encode_digests(d, ranks(), public_tokenizers.PATTERN), True),
        "toxicity": (lambda d: toxicity.score(d, toxicity.fit(d, none)), True),
        "owners": (exact.owners, True),
    }


@pytest.mark.parametrize("name", ["quality", "leaks", "count_tokens", "dedup_lines", "secrets", "remove_repeats", "near_duplicates", "encode", "encode_digests", "toxicity", "owners"])
def test_odd_inputs(spark, odd, empty, name):
    run, per_row = operators(spark)[name]
    found = run(odd).collect()
    if per_row:
        assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in odd.collect())
    assert run(empty).collect() == []


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    data = ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(a) for _ in range(n)) for a in ("ab", "aab \n", "héllo wörld ", "0123 ,.!", "中 a🙂") for n in (1, 7, 300)] + ["a" * 3000, LONG, "<|endoftext|>"]
    docs = table(spark, texts)
    found = {r.doc_id: r for r in bpe.encode_documents(docs, data, public_tokenizers.PATTERN).collect()}
    digests = {r.doc_id: r for r in bpe.encode_digests(docs, data, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text)
        assert found[i].ids == ids and bytes(found[i].decoded) == text.encode()
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()


def test_bpe_merges_of_falling_rank():
    """A merge may make a pair of lower rank; then the others of its bucket must wait."""
    pieces = [bytes([i]) for i in range(256)] + [b"bc", b"abab", b"cab", b"ab", b"ca", b"abc"]
    table = {p: i for i, p in enumerate(pieces)}
    encoder = bpe.Encoder(table, r"[\s\S]+", bpe.pair_table(table))

    def plain(text):
        parts = [bytes([x]) for x in text]
        while True:
            at = min(((table[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in table), default=None)
            if at is None:
                return [table[p] for p in parts]
            parts[at[1] : at[1] + 2] = [parts[at[1]] + parts[at[1] + 1]]

    rnd = random.Random(1)
    words = list({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 30))).encode() for _ in range(300)})
    for word, packed in zip(words, encoder.merge(words), strict=True):
        want = [table[word]] if word in table else plain(word)
        assert list(memoryview(packed).cast("I")) == want


def test_bpe_equals_the_plain_algorithm_on_random_tables():
    rnd = random.Random(21)
    for _ in range(150):
        pieces = [bytes([i]) for i in range(256)]
        for _ in range(rnd.randrange(2, 14)):
            new = rnd.choice([*pieces[97:100], *pieces[256:]]) + rnd.choice([*pieces[97:100], *pieces[256:]])
            if new not in pieces and len(new) < 9:
                pieces.append(new)
        made = pieces[256:]
        rnd.shuffle(made)
        table = {p: i for i, p in enumerate(pieces[:256] + made)}
        encoder = bpe.Encoder(table, r"[\s\S]+", bpe.pair_table(table))
        words = list({"".join(rnd.choice("abc" if k % 2 else "ab") for _ in range(rnd.randrange(1, 25))).encode() for k in range(60)})
        for word, packed in zip(words, encoder.merge(words), strict=True):
            parts = [word] if word in table else [bytes([x]) for x in word]
            while len(parts) > 1 and (best := min(((table[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in table), default=None)):
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert list(memoryview(packed).cast("I")) == [table[p] for p in parts], (word, made)


def test_token_counts_equal_greedy_cutting():
    rnd = random.Random(2)
    for _ in range(20):
        vocabulary_ = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 6))) for _ in range(8)}
        automaton = wordpiece.build_automaton(vocabulary_)
        for _ in range(50):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(0, 15)))
            at = n = 0
            while at < len(word):
                end = max((e for e in range(at + 1, len(word) + 1) if word[at:e] in vocabulary_), default=None)
                if end is None:
                    n = 1
                    break
                at, n = end, n + 1
            assert wordpiece.count_pieces(word, automaton) == n


def test_line_runs_equal_brute_force(spark):
    rnd = random.Random(3)
    pool = ["a b", "c", "", "d e f g", "x " * 12, "y " * 5, "q r s"] + [f"u{i} v{i}" for i in range(3)]
    docs = [(rnd.randrange(40), "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 30)))) for _ in range(30)]
    seen, want = set(), []
    for _, lines in sorted(((d, t.split("\n")) for d, t in docs), key=lambda x: x[0]):
        gone = set()
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(lines[j].split())
                if n >= 10:
                    run = tuple(lines[i : j + 1])
                    if run in seen:
                        gone |= set(range(i, j + 1))
                    seen.add(run)
                    break
        want.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    assert sorted(r.text for r in linededup.dedup_lines(table(spark, docs), 10).collect()) == sorted(want)


def test_secret_spans(spark):
    noise = random.Random(6)
    plain = " ".join("".join(noise.choice(["ther", "ing", "an", "sto", "ed", "re"]) for _ in range(noise.randrange(1, 8))) for _ in range(4000))
    key = "".join(noise.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [plain, f'x Api_Key = "{key[:30]}" y', "AKIA" + "Q2" * 8 + " AKIAQ2", "deadbeef" * 4 + " abc", "password: short", f"see {key} here", "ſecret=abcdefgh", 'secret: aaaaaa token="bbbbbbb"']
    docs = table(spark, texts)
    found = {r.doc_id: r for r in secrets.digests(secrets.scan(docs, secrets.train(docs))).collect()}
    counts = {i: (r.n_assign, r.n_access, r.n_hex) for i, r in found.items()}
    assert counts == {0: (0, 0, 0), 1: (1, 0, 0), 2: (0, 1, 0), 3: (0, 0, 1), 4: (0, 0, 0), 5: (0, 0, 0), 6: (0, 0, 0), 7: (2, 0, 0)}
    assert found[0].spans == "" and found[5].spans == "markov:4:44" and found[2].spans == "access:0:20"
    assert found[3].base_sha256 == hashlib.sha256(b"hex:0:32").hexdigest()
    assert found[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_secret_scores_do_not_depend_on_the_corpus_size(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted, ratios = secrets.transition_counts(docs).persist(), []
    for scale in (1, 50, 3000):
        monkeypatch.setattr(secrets, "transition_counts", lambda *_, k=scale: counted.withColumn("n", F.col("n") * k))
        ratios.append(secrets.train(docs))
    counted.unpersist()
    assert abs(ratios[0] - ratios[1]).max() < 1e-9 and abs(ratios[0] - ratios[2]).max() < 1e-9
    rnd = random.Random(8)
    keys = ["".join(rnd.choices(secrets.ALPHABET[:62], k=40)) for _ in range(20)]
    names = ["requestHandlerFactory", "DEFAULT_SESSION_SIZE", "MAX_CONNECTION_RETRIES", "get_user_account_by_name"]
    found = secrets.scan(table(spark, [f"see {x} here" for x in names + keys]), ratios[2]).collect()
    assert [r.doc_id for r in found if not r.secrets] == [0, 1, 2, 3]


@pytest.mark.parametrize("letters", ["abc", "ab", "a", "aaaaaaaaaaaaaaab"])
def test_suffix_array_is_sorted(letters):
    import numpy as np

    rnd = random.Random(1)
    for size in (1, 5, 40, 300) * 10:
        pieces = [bytes(ord(rnd.choice(letters)) for _ in range(rnd.randrange(1, size + 1))) for _ in range(rnd.randrange(1, 6))]
        data = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8) + np.uint8(1)
        text = data.tobytes()
        found = suffix.suffix_array(data, 100, suffix.names(data, 100)).tolist()
        assert sorted(found) == list(range(len(text)))
        assert [text[i : i + 100] for i in found] == sorted(text[i : i + 100] for i in range(len(text)))


def test_long_texts_after_empty_ones(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PART_BYTES", 3000)
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefgh") for _ in range(20_000))
    docs = [(i, x) for i, x in enumerate([*([""] * 62), None, long, long[:2999], "x" * 9000, long[5000:] + "y"])]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(table(spark, docs)).collect()}
    assert found[63] == (20_000, 0, 0) and found[64] == (2999, 2999, 1) and found[65] == (9000, 8999, 1) and found[66] == (15_001, 15_000, 1)


@pytest.mark.parametrize("array_bytes", [1 << 20, 2000])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, array_bytes):
    monkeypatch.setattr(suffix, "ARRAY_BYTES", array_bytes)
    if array_bytes == 2000:
        monkeypatch.setattr(suffix, "BLOCK_BYTES", 300)
        monkeypatch.setattr(suffix, "MERGED", 50)
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdé ") for _ in range(300)) for _ in range(4)] + ["ab" * 150, "hot line " * 9]
    cut = lambda x: x[(a := rnd.randrange(0, 200)) : a + rnd.randrange(20, 260)]
    part = lambda: cut(rnd.choice(base)) if rnd.random() < 0.6 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(120)))
    docs = [(rnd.randrange(35), "".join(part() for _ in range(rnd.randrange(6)))) for _ in range(40)]
    seen, want = set(), []
    for _, text in sorted(docs, key=lambda x: x[0]):
        raw = text.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(raw[i : i + 100])
        runs = len(re.findall("1+", "".join("01"[g] for g in gone)))
        want.append((len(raw), sum(gone), runs, bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    found = suffix.remove_repeats(table(spark, docs)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == sorted(want)


def test_crowded_passage_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix, "ARRAY_BYTES", 4000)
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    hot = noise(110)  # more bytes of unlike surroundings than one array takes
    docs = [(i, noise(rnd.randrange(90)) + hot + noise(rnd.randrange(90)) + (hot[:99] if i % 3 else "")) for i in range(60)]
    seen, want = set(), []
    for i, text in docs:
        raw = text.encode()
        gone = [False] * len(raw)
        for at in range(len(raw) - 99):
            if raw[at : at + 100] in seen:
                gone[at : at + 100] = [True] * 100
            seen.add(raw[at : at + 100])
        want.append((i, sum(gone), bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    found = suffix.remove_repeats(table(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in found) == want


def test_suffix_sort_keeps_within_an_executors_memory(spark):
    import tracemalloc

    rnd = random.Random(5)
    blobs = [bytes(rnd.choices(b"abcdefgh ", k=168)) for _ in range(6000)] + [b"abcdefgh " * 18] * 200
    suffix.repeated_windows(blobs[:10], 100)
    tracemalloc.start()
    try:
        suffix.repeated_windows(blobs, 100)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 * sum(map(len, blobs))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with common.small_batches(spark):
        rows = spark.range(2000, numPartitions=1).selectExpr("repeat('x', 10000) AS x").mapInArrow(sizes, "bytes long").collect()
    assert max(r.bytes for r in rows) < 5 << 20 and sum(r.bytes for r in rows) >= 20_000_000
    assert spark.conf.get(key) == before


def test_fingerprints_and_components_equal_brute_force(spark):
    import xxhash

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(2, 6)))
    base = [[word() for _ in range(60)] for _ in range(6)]
    texts = ["", " \x0b", "One two", "one TWO", "É x y z"]
    for _ in range(120):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = word()
        texts.append(" ".join(words))

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fingerprint(t) for t in texts]
    component = list(range(len(fps)))
    for _ in fps:
        component = [min(component[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert found == {i: (f"{fps[i]:016x}", component[i]) for i in range(len(fps))}


def test_crowded_lists_connect_all_links(spark, monkeypatch):
    import numpy as np

    rnd = random.Random(7)
    monkeypatch.setattr(simhash, "CROWDED", 30)

    def classes(pairs, n):
        up = list(range(n))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[find(int(a))] = find(int(b))
        roots = [find(x) for x in range(n)]
        return [roots.index(x) for x in roots]

    for free in (64, 32, 12):
        seeds = [rnd.getrandbits(64) for _ in range(4)]
        fps = sorted({rnd.choice(seeds) ^ sum(1 << rnd.randrange(free) for _ in range(rnd.randrange(6))) & ((1 << free) - 1) for _ in range(200)})
        links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
        if free == 12:  # over CROWDED with five bytes fixed: neighbours are looked up
            one = [x for x in fps if x >> 12 == fps[0] >> 12]
            assert classes(simhash.spanning(np.array(one, np.uint64)), len(one)) == classes([(i, j) for i, j in links if i < len(one) and j < len(one)], len(one))
        rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
        assert classes([(r.a, r.b) for r in simhash.links(rows).collect()], len(fps)) == classes(links, len(fps))


def test_covering_sets():
    from itertools import combinations

    sets = [set(s) for s in simhash.covering()]
    assert all(any(s <= set(x) for s in sets) for x in combinations(range(8), 5))


@pytest.mark.parametrize("trie_bytes", [64 << 20, 4000])
def test_exact_owners(spark, monkeypatch, trie_bytes):
    monkeypatch.setattr(exact, "TRIE_BYTES", trie_bytes)
    texts = ["Same", "sAME", "other", None, "", "Éa", "éa", (9, "same"), (9, "same"), (4, "z"), "x" * 120_000, "X" * 120_000, "x" * 120_001, "x" * 5000 + "y"]
    docs = table(spark, texts)
    found = exact.owners(docs).collect()
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
    want = [(i, max(j for j, u in rows if fold(u) == fold(t)), sum(fold(u) == fold(t) for _, u in rows), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == sorted(want)
    assert sum(r.kept for r in found) == len({w[3] for w in want})


def test_trie_spills_by_subtree():
    rnd = random.Random(8)
    long = "".join(rnd.choice("ab") for _ in range(3000)).encode()
    keys = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 40))) for _ in range(600)]
    keys += [long[: rnd.randrange(3000)] + rnd.choice([b"", b"x", b"yz"]) for _ in range(60)] + [long * 3] * 3 + [b"q" * 9000]
    for limit in (4000, 400, None):
        trie = exact.Trie(lambda a, b: a + b, limit)
        for key in keys:
            trie.insert(key, 1)
        assert (limit is None) == (not trie.files)
        found = list(trie.items())
        assert dict(found) == {k: keys.count(k) for k in keys} and len(found) == len(set(keys))


def test_leaks_equal_the_sets(spark):
    rnd = random.Random(10)
    word = lambda: rnd.choice(["alpha", "beta", "Gamma", "delta", "eps"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([2, 3, 5, 6, 12, 30, 60])]
    texts = []
    for _ in range(60):
        _, text = rnd.choice(items)
        words = text.split()
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = "odd"
        texts.append(" ".join([*(word() for _ in range(rnd.randrange(40))), ", ".join(words), *(word() for _ in range(rnd.randrange(9)))]))

    def shingles(text, n):
        w = re.findall(r"[a-z]+", text.lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {}
    for i, x in items:
        n = min(5, len(x.split()))
        for d, t in enumerate(texts):
            if len(shingles(x, n) & shingles(t, n)) >= 0.8 * len(shingles(x, n)):
                want[d, i] = len(shingles(x, n) & shingles(t, n))
    found = decontaminate.leaks(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.n_shared for r in found.collect()} == want


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice(["ba", "de", "ko", "mi", "ru"]) for _ in range(3)) for _ in range(60)]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 5 == 1
        text = [rnd.choice(words) for _ in range(40)]
        if toxic:
            for _ in range(3):
                text[rnd.randrange(40)] = "grobzak" + rnd.choice(["en", "a", "olu", "ist"])
        rows.append(" ".join(text))
        marks.append((i, 1, int(toxic)))
    docs = table(spark, rows)
    found = toxicity.score(docs, toxicity.fit(docs, labels(spark, marks))).withColumn("out", toxicity.held_out()).where("out").collect()
    assert len(found) > 60 and sum(r.predicted == marks[r.doc_id][2] for r in found) >= 0.98 * len(found)
    kept = toxicity.drop_toxic(docs, toxicity.fit(docs, labels(spark, marks)))
    assert kept.columns == docs.columns and 450 <= kept.count() <= 500


def test_toxicity_counts_do_not_depend_on_tasks(spark):
    rnd = random.Random(12)
    rows = [" ".join(f"w{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(8))}q" for _ in range(6)) for _ in range(200)]
    marks = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    train = toxicity.training_rows(table(spark, rows), labels(spark, marks), 20_000)
    whole, spread = (toxicity.suggested(train.repartition(n), 400, 2000) for n in (1, 20))
    assert whole == spread


def test_label_model_is_no_copy_of_the_labels():
    import numpy as np

    rnd = np.random.default_rng(3)
    toxic = rnd.random(600) < 0.2
    fired = (rnd.random((600, 12)) < np.where(toxic[:, None], 0.35, 0.002))
    row, on = np.nonzero(fired)
    wrong = toxic.copy()
    flipped = rnd.choice(600, 20, replace=False)
    wrong[flipped] = ~wrong[flipped]
    alone = toxicity.label_model(row, on, 12, 600, 0.2) >= 0.5
    anchored = toxicity.label_model(row, on, 12, 600, 0.2, wrong.astype(float)) >= 0.5
    assert (alone == toxic).mean() > 0.97 and (anchored == toxic).mean() > 0.97
    assert (anchored[flipped] == toxic[flipped]).mean() > 0.6  # votes outweigh wrong labels


def test_quality_shrinks_sparse_sites(spark):
    rnd = random.Random(12)
    good = lambda: " ".join(rnd.choice(["the", "river", "runs", "down", "to", "a", "quiet", "sea"]) for _ in range(50)) + "."
    bad = lambda: " ".join(rnd.choice(["BUY!!", "NOW$$", "###", "FREE!!"]) for _ in range(50))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", "big" if i < 380 else f"s{i}", 1, 2, 3, 4, 5, 6, 7) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = quality.classify(docs, quality.fit(docs, labels(spark, [(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)]))).collect()
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in found) >= 396
    rate = {r.host: r.host_rate for r in found}
    assert 0.7 < rate["big"] < 0.8 and all(0.3 < x < 0.95 for x in rate.values())


def test_quality_scores_equal_brute_force(spark):
    import math

    rnd = random.Random(14)
    rows = [(i, rnd.choice(["a fine day. ", "BUY!! ##", "x y z "]) * rnd.randrange(1, 30), rnd.choice([None, "p", "q"]), rnd.choice(["h", "k", None]) if i % 3 else "h", 1, 2, 3, 4, 5, 6, 7) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = quality.classify(docs, quality.fit(docs, labels(spark, [(i, int("fine" in rows[i][1]), 0) for i in range(0, 150, 2)]))).collect()
    p = {r.doc_id: r.evidence for r in found}
    site = {r.doc_id: (r.host, r.path) for r in found}
    assert site == {i: (h or "", lang or "") for i, _, lang, h, *_ in rows}

    def total(ids):
        ids = list(ids)
        return sum(p[i] for i in ids), len(ids)

    def strength(parent, sites):
        n, k, noise = sum(m for _, m in sites), len(sites), parent * (1 - parent)
        between = (sum(m * (s / m - parent) ** 2 for s, m in sites) - (k - 1) * noise) / max(n - sum(m * m for _, m in sites) / n, 1e-9)
        return min(max(noise / max(between, 1e-9), 2.0), 1000.0)

    overall = sum(p.values()) / len(p)
    hosts = {h: total(i for i in p if site[i][0] == h) for h in {x for x, _ in site.values()}}
    a = strength(overall, list(hosts.values()))
    rate = {h: (s + a * overall) / (n + a) for h, (s, n) in hosts.items()}
    paths = {x: total(i for i in p if site[i] == x) for x in set(site.values())}
    b = {h: strength(rate[h], [v for x, v in paths.items() if x[0] == h]) for h in hosts}
    logit = lambda x: math.log(x / (1 - x))
    for r in found:
        (s, n), h = paths[site[r.doc_id]], r.host
        others = (s - r.evidence + b[h] * rate[h]) / (n - 1 + b[h])
        want = 1 / (1 + math.exp(-(logit(r.evidence) + logit(others) - logit(overall))))
        assert abs(r.host_rate - rate[h]) < 1e-9 and abs(r.path_rate - (s + b[h] * rate[h]) / (n + b[h])) < 1e-9 and abs(r.score - want) < 1e-9


def test_secret_query_equals_brute_force(spark, sf_dir):
    from quorumlake.llm.queries import QUERIES

    def either(word):
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)

    patterns = [("assign", "(" + "|".join(map(either, ["password", "passwd", "secret", "token", "api_?key"])) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    found = {r.doc_id: r for r in QUERIES["op5_secret_scan"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc in docs:
        spans = [(m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(patterns) for m in re.finditer(pattern, doc.text or "") if len(m[group]) >= least]
        base = ",".join(f"{patterns[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
        r = found[doc.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert [x for x in r.spans.split(",") if x and not x.startswith("markov")] == [x for x in base.split(",") if x]


def test_token_count_query_equals_brute_force(spark, sf_dir):
    ranks_ = bpe.parse_ranks(ranks())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40)
    vocabulary_, longest = set(ranks_), max(map(len, ranks_))
    for r, text in zip(sorted(wordpiece.count_tokens(docs, ranks_).collect()), [x.text for x in docs.collect()], strict=True):
        n = 0
        for word in text.encode().split():
            word, at = b" " + word, 0
            while at < len(word):
                at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in vocabulary_)
                n += 1
        assert r.n_tokens == n


def test_hot_keys_are_dealt_and_joined_whole(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    counts = common.cut(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    found = common.join_hot(rows, counts, ["k"], ["id"])
    assert sorted(map(tuple, found.select("id", "k", "least").collect())) == sorted(map(tuple, rows.join(counts.drop("n"), "k").select("id", "k", "least").collect()))
    assert found.columns == ["k", "id", "least"]


def test_components_of_a_star_and_a_chain(spark):
    links = [(5, 1000 + i) for i in range(1500)] + [(i, i + 1) for i in range(3000, 3040)] + [(4000, 4000), (None, 1)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {5: 5, **{1000 + i: 5 for i in range(1500)}, **{i: 3000 for i in range(3000, 3041)}}
    assert found == want


def test_tables_are_numbered_once_and_names_stay_free(spark):
    docs = spark.range(100).repartition(5).select("id", F.rand().alias("row__"), F.lit("x").alias("ROW___"))
    table_, name = common.numbered(docs)
    assert name not in ("row__", "ROW___") and table_.columns == ["id", "row__", "ROW___", name]
    again = {r.id: r[name] for r in table_.collect()}
    assert again == {r.id: r[name] for r in table_.repartition(3).collect()} and len(set(again.values())) == 100
    common.discard(spark)
