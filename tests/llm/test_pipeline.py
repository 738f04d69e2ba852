"""Each stage of the pipeline against a plain version over its own input."""

from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.test_near_duplicates import LOW, roots, sets_of, similar
from tests.llm.test_quality_and_mixing import WORD, base, fill
from tests.llm.test_texts import KINDS, base_private
from tickweave.llm import pieces, quality
from tickweave.llm.common import ROW


@pytest.fixture(scope="module")
def stages(spark, sample, tmp_path_factory):
    """Rows before the first and after each stage."""
    folder, docs = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{sample}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sample).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mix_sources", "sentencepiece"]
    assert all(s.columns == stages[0].columns for s in stages[:-1]) and stages[-1].count() > 0


def test_quality_stage(stages):
    kept = Counter(map(tuple, stages[1].collect()))
    verdict = {tuple(r[ROW]): r.kept for r in quality.quality(stages[0]).collect()}
    want = Counter(r for r in map(tuple, stages[0].collect()) if verdict[r])
    assert kept == want and not any(base(r[1])[5] for r in kept)


def test_near_duplicate_stage(stages):
    sets = sets_of([(r.doc_id, r.text) for r in stages[1].collect()], corpus_pipeline.STAGE_WORDS)
    top = roots(list(sets), similar(sets))
    assert Counter(map(tuple, stages[2].collect())) == Counter(tuple(r) for r in stages[1].collect() if top[r.doc_id] == r.doc_id)


def test_personal_data_stage(stages):
    before, after = {r.doc_id: r for r in stages[2].collect()}, {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, r in before.items():
        spans = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in base_private(r.text)))
        text, at = "", 0
        for a, b, k in spans:
            if a >= at:
                text += r.text[at:a] + f"[{k.upper()}]"
            at = max(at, -b)
        assert after[i].text == text + r.text[at:] and after[i].n_chars == len(after[i].text) and (after[i].lang, after[i].source) == (r.lang, r.source)
    assert any("[EMAIL]" in r.text for r in after.values()) and set(KINDS) == {"email", "ip", "card", "phone"}


def test_mixing_stage(stages):
    sizes, taken = Counter(), Counter()
    known = {r.doc_id: r for r in stages[3].collect()}
    for r in known.values():
        sizes[r.source] += len(WORD.findall(r.text))
    for r in stages[4].collect():
        words, whole = WORD.findall(r.text), WORD.findall(known[r.doc_id].text)
        assert words == whole[: len(words)] and r.n_chars == len(r.text)
        taken[r.source] += len(words)
    assert all(abs(taken[s] - t) <= 1 for s, t in fill(sizes).items())


def test_token_stage(stages):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = Counter((r.doc_id, tuple(r.ids)) for r in stages[5].collect())
    assert got == Counter((r.doc_id, tuple(model.encode(r.text))) for r in stages[4].collect())
    assert all(r.round_trip for r in stages[5].collect())


def test_run_on_awkward_and_empty_tables(spark, odd, tmp_path):
    """Columns beyond those of documents are carried; run() chains the stages over what the folder holds."""
    odd.unionByName(odd.limit(0)).write.parquet(f"{tmp_path}/odd/documents.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in odd.collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_duplicate_stage_takes_five_words(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    rows, sets = docs.collect(), {}
    for r in rows:
        w = (r.text or "").encode().translate(LOW).split()
        sets[r.doc_id] = frozenset(zip(*[w[k:] for k in range(min(5, len(w)))]))
    top, pairs = roots(list(sets), similar(sets)), sets_of([(r.doc_id, r.text) for r in rows])
    want = {i for i in sets if top[i] == i}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sample).collect()} == want
    two = roots(list(pairs), similar(pairs))
    assert want - {i for i in pairs if two[i] == i}
