import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard_join, queries
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    same(queries.queries()[name](spark, small), duck, queries.oracle_sql()[name])


def test_stages_against_plain_versions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("found", F.lit("clash"))
    bench = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    def run(name, df):
        out = stage[name](spark, df, small)
        assert out.columns == docs.columns
        return corpus_pipeline.materialise(out, name)

    odd = docs.limit(1).withColumn("doc_id", F.lit(10**6).cast("long")).withColumn("text", F.lit("12 34"))
    one = run("language", docs.unionByName(odd))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in one.collect()} == {i for i, t in before.items() if re.search(r"[^\W\d_]", t or "")}

    two = run("near_duplicates", one)
    classes = jaccard_join.brute_force([(r["doc_id"], r["text"]) for r in one.collect()])
    assert {r["doc_id"] for r in two.collect()} == {i for i, (c, _) in classes.items() if c == i}

    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    items = [sh(b) for b in bench]
    three = run("decontamination", two)
    left = {r["doc_id"]: r["text"] for r in two.collect()}
    assert {r["doc_id"] for r in three.collect()} == {i for i, t in left.items() if not any(b and len(b & sh(t)) >= 0.8 * len(b) - 1e-9 for b in items)}

    four = run("secrets", three)
    clean = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        assert r["n_chars"] == len(r["text"]) and not re.search(r"token = \"[0-9a-f]{40}", r["text"])
        if "[SECRET]" not in r["text"]:
            assert r["text"] == clean[r["doc_id"]]
    assert four.count() == three.count()
    packed = stage["packing"](spark, four, small)
    assert packed.select("doc_id").distinct().count() == four.count()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {r["doc_id"]: len(tk.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in four.collect()}
    sums = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sums == lengths
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top")).where("n <> top or n > 2048").count() == 0


def plain_redaction(text):
    """Spans of the base rules, one after the other, put out by plain expressions."""
    from tests.llm.test_operators import plain_secrets

    while plain_secrets(text):
        spans = sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in plain_secrets(text).split(","))
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        text = out + text[at:]
    return text


def test_secrets_stage_against_a_plain_version(spark, small):
    from tests.llm.test_operators import SECRETS

    texts = [t for t in SECRETS if "eyJ" not in (t or "")] + ["token" * 3 + "=abcdef", "api_token=secret=abcdefgh tail"]
    docs = spark.createDataFrame([(i % 7 if i % 7 else None, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").withColumn("_blob", F.lit("clash"))
    out = corpus_pipeline.secrets(spark, docs, small)
    assert out.columns == docs.columns
    want = sorted((str(i % 7 if i % 7 else None), str(t if t is None else plain_redaction(t))) for i, t in enumerate(texts))
    got = out.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)


def test_redacted_texts_are_scanned_alone(spark):
    from tessera.llm import secret_scan

    docs = spark.createDataFrame([(i, f"token=abcdef{i}" if i < 3 else f"clean {i}") for i in range(20)], "doc_id long, text string")
    findings, ledger = secret_scan.scan(docs)
    redacted = corpus_pipeline._redacted(docs, findings.where("found is not null"))
    _, after = secret_scan.scan(redacted, ledger)
    assert ledger.count() == 20 and after.count() == 21  # the three redacted texts are one new blob


def test_pipeline_on_an_empty_table(spark, small, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0 if t == "documents" else 5).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_drops_unlearned_languages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 500 and doc_id % 2 = 0").orderBy("doc_id").collect()}
    russian, polish = "Съешь же ещё этих мягких французских булок, да выпей чаю.", "Pchnąć w tę łódź jeża lub ośm skrzyń fig, mężny bądź."
    texts = [russian, polish, "漢字の文章です", by["en"][:400] + " " + by["fr"][:400] + " " + by["de"][:400], by["es"] + " " + russian, by["de"], "12 34", None]
    new = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = docs.unionByName(new, allowMissingColumns=True)
    out = {r["doc_id"] for r in corpus_pipeline.language(spark, both, small).select("doc_id").collect()}
    assert {i - 10**6 for i in out if i >= 10**6} == {3, 4, 5}
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= out
    unknown = both.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unknown, small).count() == both.count()


def test_stages_on_messy_tables(spark, small):
    """Null and repeated ids, repeated rows, empty and very long texts, clashing columns: each stage gives what its docstring says."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    learned = docs.where("doc_id < 60 and length(text) > 40")
    bench = spark.read.parquet(f"{small}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first()["text"]
    text = learned.orderBy("doc_id").first()["text"]
    rows = [(None, text), (None, None), (10**6, text + " first"), (10**6, text + " first"), (10**6 + 1, text + " first"), (10**6 + 2, ""), (10**6 + 3, (text + " ") * 200), (10**6 + 4, "so " + bench + " it is"), (10**6 + 5, "token=abcdefgh " * 3000)]
    new = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("messy"))
    messy = learned.unionByName(new, allowMissingColumns=True).withColumns({c: F.lit(7) for c in ("blob", "_found", "rep", "grp", "class_id", "text_hash", "places", "least", "salt", "length", "rank", "unlearned")})
    stage, n = dict(corpus_pipeline.STAGES), learned.count()

    def ids(df):
        assert df.columns == messy.columns
        return sorted(((r["doc_id"] or -1) - 10**6, (r["text"] or "")[:5]) for r in df.where("source = 'messy'").collect())

    assert [i for i, _ in ids(stage["language"](spark, messy, small))] == [-10**6 - 1, -10**6 - 1, 0, 0, 1, 3, 4]  # the secrets are in no language
    named = dict((r["doc_id"], r["text"]) for r in messy.where("doc_id is not null").collect())
    classes = jaccard_join.brute_force(list(named.items()))
    assert [i for i, _ in ids(stage["near_duplicates"](spark, messy, small))] == sorted((i or -1) - 10**6 for i, _ in rows if i is None or classes[i][0] == i)
    assert 4 not in [i for i, _ in ids(stage["decontamination"](spark, messy, small))]
    out = stage["secrets"](spark, messy, small)
    assert len(ids(out)) == len(rows) and dict(ids(out))[5] == "[SECR"
    packed = stage["packing"](spark, messy, small)
    assert packed.where("doc_id is null and start = 0").count() == 2 and packed.where("doc_id = 1000000 and start = 0").count() == 2
    assert packed.where("start = 0").count() == n + len(rows)
