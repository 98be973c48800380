"""The pipeline against plain Python over the same rows; each stage on odd rows."""
import pytest

import corpus_pipeline
from penalytics.llm import decontaminate, simhash
from penalytics.sources.tables import table_path


def test_against_brute_force(spark, small):
    sentencepiece = pytest.importorskip("sentencepiece")
    from penalytics.llm.queries import MODEL_FILE
    rows = {r.doc_id: r.text for r in spark.read.parquet(table_path(small, "documents")).collect()}
    items = [D for D in (decontaminate.words_of(r.text) for r in spark.read.parquet(table_path(small, "benchmark")).collect()) if D]
    kept = {i: t for i, t in rows.items() if any(c.isalpha() for c in t)}
    last = {}
    for i in sorted(kept):
        last[kept[i]] = i
    kept = {i: t for t, i in last.items()}
    prints, gone, queue = {i: simhash.fingerprint(t.encode()) for i, t in kept.items()}, set(), []
    for i in sorted(kept):
        if i in gone:
            continue
        queue, group = [i], {i}
        while queue:
            a = queue.pop()
            near = {b for b in kept if b not in group and (prints[a] ^ prints[b]).bit_count() <= 2}
            group |= near
            queue += near
        gone |= group - {i}
    kept = {i: t for i, t in kept.items() if i not in gone}

    def leaks(text):
        text = " " + " ".join(decontaminate.words_of(text)) + " "
        return any(" " + " ".join(w) + " " in text for w in items)

    expected = {i: t for i, t in kept.items() if not leaks(t)}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(found) == set(expected)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    assert all(found[i].token_ids == library.encode(t) and found[i].round_trip for i, t in expected.items())


def test_stages_return_the_columns_of_documents(spark, small, docs_of):
    odd = docs_of([(1, None), (1, None), (None, "the end of it and all"), (2, ""), (3, "the end of it and all"), (3, "the end of it and all")])
    odd = odd.drop("id", "hash", "fp")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontaminate", "sentencepiece"]
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, odd, small)
        rows = out.collect()
        if name != "sentencepiece":
            assert out.columns == odd.columns
        assert len(rows) == {"language_id": 3, "exact_dedup": 2, "simhash_near_dedup": 2, "decontaminate": 6, "sentencepiece": 6}[name]
        assert step(spark, odd.limit(0), small).count() == 0
