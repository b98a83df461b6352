"""The pipeline against a plain version of each stage on a small corpus."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from whyframe.llm.decontamination import Items  # noqa: E402

from .helpers import prose  # noqa: E402
from .test_decontamination import distance, norm  # noqa: E402
from .test_line_dedup import exact  # noqa: E402
from .test_ngram_join import brute  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    base = tmp_path_factory.mktemp("corpus")
    item = " ".join(prose(rng, 25))
    docs = []
    for k in range(160):
        lines = [" ".join(prose(rng, rng.randrange(15, 40))) for _ in range(rng.randrange(2, 5))]
        if k % 4 == 0:
            lines[0] += f" {rng.choice(['blorgface', 'snarkwit'])}"
        if k % 7 == 1:
            lines.append("this boiler plate line stands in many documents")
        if k % 20 == 3:
            lines[1] += " " + item
        docs.append((k, "\n".join(lines), "en", "s", 0))
    for k in (5, 6, 9):  # near copies: words move over line breaks, so lines differ
        words = docs[k][1].split()
        docs.append((200 + k, "\n".join(" ".join(words[a : a + 11]) for a in range(0, len(words), 11)), "en", "s", 0))
    docs += [(300, docs[10][1], "en", "s", 0), (301, None, None, None, None), (302, "", "en", "s", 0)]
    docs = [(i, t, a, b, None if t is None else len(t)) for i, t, a, b, _ in docs]
    labels = [(i, 1, int(any(w in t for w in ("blorgface", "snarkwit")))) for i, t, *_ in docs[:140]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{base}/labels.parquet")
    spark.createDataFrame([(1, item), (2, " ".join(prose(rng, 30)))], "item_id long, text string").write.parquet(f"file://{base}/benchmark.parquet")
    return f"file://{base}", docs, item


def test_stages(spark, folder, tmp_path):
    path, docs, item = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    steps = []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, df, path)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"file://{tmp_path}/{k}")
        df = spark.read.parquet(f"file://{tmp_path}/{k}")
        steps.append(df)
    text = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:4]]
    given = {i: t for i, t, *_ in docs}
    toxic = {i for i, t in given.items() if t and any(w in t for w in ("blorgface", "snarkwit"))}
    assert text[0] == {i: t for i, t in given.items() if i not in toxic}
    lines = exact([(i, t) for i, t in text[0].items() if t is not None])
    want = {i: (lines[i] if t is not None else None) for i, t in text[0].items()}
    assert text[1] == {i: t for i, t in want.items() if t or not given[i]}
    lengths = {r.doc_id: r.n_chars for r in steps[1].collect()}
    assert all(lengths[i] == (None if t is None else len(t)) for i, t in text[1].items())
    groups = brute(list(text[1].items()), 5, 80)
    assert text[2] == {i: t for i, t in text[1].items() if groups[i][1] == i} and len(text[2]) < len(text[1])
    limit = Items([(1, item)], 10, 0.08).edits[0]
    assert text[3] == {i: t for i, t in text[2].items() if t is None or distance(norm(item), norm(t)) > limit} and len(text[3]) < len(text[2])
    assert {r.doc_id for r in steps[4].select("doc_id").collect()} == set(text[3])
    whole = corpus_pipeline.run(spark, path)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, steps[4].select(key).collect()))


def test_empty_corpus(spark, folder, tmp_path):
    path, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
