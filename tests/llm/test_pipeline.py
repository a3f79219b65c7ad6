import sentencepiece

import corpus_pipeline
import public_tokenizers
from sparkloom.llm import mixing, secrets, toxicity
from sparkloom.llm.common import written

from . import test_jaccard, test_secrets

SMALL = "/root/testdata/sf0.001"


def plain(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL))
        outs.append(docs)
    first = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.with_scores(first, model).collect()}
    assert all(o.columns == columns for o in outs[:-1])
    assert plain(outs[0]) == [r for r in plain(first) if scores[r[0]] < toxicity.THRESHOLD]
    kept = {c for _, _, c in test_jaccard.brute(plain(outs[0]), 5, 80)}
    assert plain(outs[1]) == [r for r in plain(outs[0]) if r[0] in kept]

    def cleaned(r):
        spans = [s.split(":") for s in test_secrets.brute(r[1])[-1].split(",") if s]
        out, at = "", 0
        for kind, a, b in spans:
            if int(a) >= at:
                out += r[1][at : int(a)] + f"<{kind}>"
            at = max(at, int(b))
        return (r[0], out + r[1][at:], r[2], r[3], len(out + r[1][at:]) if spans else r[4])

    assert plain(outs[2]) == [cleaned(r) for r in plain(outs[1])]
    copies = {r["doc_id"]: r["__copies"] for r in mixing.with_copies(outs[2]).collect()}
    assert 0.8 < sum(len(r[1].split()) for r in plain(outs[3])) / sum(len(r[1].split()) for r in plain(outs[2])) < 1.2
    assert plain(outs[3]) == sorted((r for r in plain(outs[2]) for _ in range(copies[r[0]])), key=str)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(((r[0], [*sp.encode(r[1]), 2]) for r in plain(outs[3])), key=str)
    assert sorted(((r["doc_id"], r["piece_ids"]) for r in outs[4].collect()), key=str) == want


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL))
    assert docs.count() == 0


def test_awkward_rows_and_names(spark):
    """Nulls, empty and long texts, repeated rows and columns with the operators' own names, through every stage."""
    from .helpers import rows

    names = ("__key", "__kept", "__hash", "__score", "score", "__size", "__copies", "__copy", "row", "own", "hash", "key", "kept", "component", "Text_hash")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    data = [(*r[:5], *names) for r in rows()] + [(900, "password=hunter22 " + "many words here " * 200_000, "en", None, 3, *names)]
    docs = spark.createDataFrame(data, schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = written(stage(spark, docs, SMALL))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        assert all(r["__key"] == "__key" and r["Text_hash"] == "Text_hash" and r["__size"] == "__size" for r in docs.collect()), name
        assert name == "mixing" or docs.count() <= before
    assert "<assign>" in {r["text"][:8] for r in docs.where("doc_id = 900").collect()}
    assert written(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)).columns == ["doc_id", "source", "n_tokens", "piece_ids"]
