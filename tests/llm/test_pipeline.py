"""The pipeline's stages: each decision takes effect, columns stay, clean documents stay."""

import corpus_pipeline


def test_stages_follow_each_other(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        n = docs.count()
        assert 0 < n <= before
        before = n
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]


def test_copies_and_leaks_go_and_clean_documents_stay(spark, tmp_path):
    import random

    rnd = random.Random(13)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7))) for _ in range(n))
    item, base = text(40), "\n".join(text(60) for _ in range(4))
    docs = [(0, base), (1, base), (2, base.replace(" ", "  ", 1)), (3, text(200) + " " + item), (4, text(200)), (5, text(200) + "\n" + base.split("\n")[0]), (6, ""), (7, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, leaked__ long, row__ long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {0, 2, 4, 5, 6} <= found and not found & {1, 3}


def test_line_dedup_keeps_what_documents_alone_hold(spark):
    import random

    rnd = random.Random(17)
    line = lambda n=12: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c, base = line(), line(), line(), [line(40) for _ in range(5)]
    docs = {0: [line(60), a], 1: [line(60), b], 2: [line(60), c], 3: [a, b, c, "five words of its own"], 4: [a, b], 5: base, 6: [*base[:4], base[4] + " more"], 7: [*base[:4], line(), "end"]}
    rows = [(i, "\n".join(x), "en", "s", 0, 5, 6) for i, x in docs.items()]
    columns = "doc_id long, text string, lang string, source string, n_chars long, dedup__ long, runs__ long"
    found = {r.doc_id: r for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, columns).coalesce(1), "").collect()}
    assert sorted(found) == [0, 1, 2, 3, 5, 6, 7]  # of 4 nothing is left
    assert found[3].text == "five words of its own" and found[3].n_chars == 21
    assert found[6].text.split("\n") == docs[6][4:] and found[7].text.split("\n") == docs[7][4:]
    assert (found[7].dedup__, found[7].runs__) == (5, 6)


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Each stage by plain Python over all documents of the small tables; the classifier's weights are the stage's own."""
    import hashlib
    import re

    import public_tokenizers
    import tiktoken
    import xxhash

    from quorumlake.llm import bpe, toxicity
    from quorumlake.llm.queries import vocabulary

    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    score = toxicity.scorer(toxicity.fit(tables["documents"], tables["labels"]))
    docs = {r.doc_id: r.text for r in tables["documents"].collect()}
    docs = {i: t for i, t in sorted(docs.items()) if score(t or "") < 0.5}

    seen, left = set(), {}
    for i, text in docs.items():
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b].split())
                if n >= 10:
                    run = tuple(lines[a : b + 1])
                    if run in seen:
                        gone |= set(range(a, b + 1))
                    seen.add(run)
                    break
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or text.strip():
            left[i] = text

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints, component = {i: fingerprint(t) for i, t in left.items()}, {i: i for i in left}
    near = {i: [j for j in left if (prints[i] ^ prints[j]).bit_count() <= 3] for i in left}
    while (new := {i: min(component[j] for j in near[i]) for i in left}) != component:
        component = new
    left = {i: t for i, t in left.items() if component[i] == i}

    def shingles(text):
        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    items = [shingles(r.text) for r in tables["benchmark"].collect()]
    clean = {i: t for i, t in left.items() if not any(len(x & shingles(t)) >= 0.8 * len(x) for x in items if x)}
    assert len(docs) > len(left) > len(clean) > 50

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))), special_tokens={})
    found = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert found == {i: (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in clean.items()}
