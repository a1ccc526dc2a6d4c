import numpy as np
import tiktoken
import public_tokenizers

import corpus_pipeline as cp
from pvlens.llm import bpe, decontamination, quality, simhash
from pvlens.llm.common import written
from tests.llm.test_decontamination import holds
from tests.llm.test_pii import brute
from tests.llm.test_simhash import fingerprint, linked


def test_against_brute_force(spark, sf, texts):
    """Each stage over what the one before kept, the classifier's scores given."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    machine = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = machine.score([texts[i].encode() for i in sorted(texts)])
    left = [i for i, s in zip(sorted(texts), scores) if s >= 0.3]
    roots = linked([fingerprint(texts[i]) for i in left])
    left = [i for n, i in enumerate(left) if roots[n] == n]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [i for i in left if not any(holds(texts[i], item) for item in items)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS_FILE)).of)
    got = {r["doc_id"]: r for r in cp.run(spark, sf).collect()}
    assert sorted(got) == left and 0 < len(left) < len(texts)
    for i in left:
        text, at = "", 0
        for kind, start, end in brute(texts[i]):
            if start >= at:
                text += texts[i][at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        text += texts[i][at:]
        r = got[i]
        assert (r["text"], r["n_chars"], r["lang"], r["source"]) == (text, len(text), rows[i]["lang"], rows[i]["source"])
        assert bytes(r["ids"]) == np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert r["n_tokens"] == len(r["ids"]) // 4 and r["round_trip"]


def test_stages_take_odd_rows(spark, sf, odd, empty):
    for docs in (odd, empty):
        for name, stage in cp.STAGES:
            before = docs
            docs = written(stage(spark, docs, sf), f"odd-{name}")
            if name != "tokens":
                assert docs.columns == before.columns
    kept = written(cp.near_duplicate_stage(spark, odd, sf), "odd-kept").collect()
    assert len({(r["doc_id"], r["text"]) for r in kept}) == len(kept)  # repeated rows are one
    assert sum(not (r["text"] or "").split() for r in kept) == 1


def test_stage_names_and_guard(spark, sf):
    assert [f for _, f in cp.STAGES] == [cp.quality_stage, cp.near_duplicate_stage, cp.decontamination_stage,
                                         cp.pii_stage, cp.token_stage]
    import __spark_entry__ as entry
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert decontamination.THRESHOLD == 0.6 and simhash.MAX_BITS == 3
