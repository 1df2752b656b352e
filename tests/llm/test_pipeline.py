"""The pipeline against a brute-force version of its stages, and the registered queries' shapes."""

import random
import zlib

import corpus_pipeline
from brindle.llm import packing, toxicity
from brindle.llm.queries import QUERIES, tokenizer_path

from .test_ops import brute_components, brute_lines, brute_windows, gibberish


def tables(spark, folder):
    r = random.Random(12)
    docs = []
    for i in range(120):
        body = gibberish(1000 + i, r.randint(20, 120))
        if i % 6 == 0:
            words = body.split()
            for _ in range(4):
                words.insert(r.randrange(len(words)), "vile" + r.choice("abcdefgh") + r.choice("xyz"))
            body = " ".join(words)
        docs.append((i, body + ("\nCookie notice" if i % 2 else ""), "en", f"s{i % 3}"))
    bench = [(0, gibberish(5000, 25)), (1, gibberish(5001, 12))]
    docs += [(200, docs[1][1], "en", "s0"), (201, docs[7][1] + " tail", "en", "s1"), (202, gibberish(1, 30) + " " + bench[0][1] + " end", "en", "s2"), (203, None, "en", "s1"), (204, "", None, None), (205, "Cookie notice", "en", "s1")]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(120)]
    spark.createDataFrame([(*d, len(d[1]) if d[1] is not None else None) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, labels, bench


def brute(docs, labels, bench):
    """(doc_id, number of tokens) of what is packed."""
    text = {d[0]: d[1] for d in docs}
    known = sorted((i, text[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    field = toxicity.fit([t for _, t, _ in known], [y for _, _, y in known])
    score = field.scorer()
    import numpy as np

    kept = []
    for i, t, lang, source in docs:
        emit = np.array([score(w) for w in toxicity.TOKEN.findall((t or "").lower())])
        if field.probability(toxicity.forward_backward([emit], field.trans)[0][0]) < 0.3:
            kept.append((i, source, t))
    lines = [(i, t) for i, t, _, _ in brute_lines(kept, 0.05, 5)]
    groups = {i for i, _, c in brute_components(lines) if i == c}
    rest = [(i, t) for i, t in lines if i in groups]
    hits = brute_windows(rest, bench)
    encode = packing.encoder(tokenizer_path())
    return sorted((i, len(encode(t or "")) + 1) for i, t in rest if not hits[i][1])


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, labels, bench = tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {}
    for r in got:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    want = brute(docs, labels, bench)
    assert sorted(sizes.items()) == want
    ids = {i for i, _ in want}
    assert not ids & {0, 6, 12, 202} and {203, 204} <= ids and len(ids & {1, 200}) == 1 and len(ids & {7, 201}) == 1


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
