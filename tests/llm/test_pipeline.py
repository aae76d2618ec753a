import hashlib  # noqa: F401
import importlib.util
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import test_decontaminate as leaks  # noqa: E402
import test_mixing as mixes  # noqa: E402
import test_ngram_join as near  # noqa: E402
import test_quality_rules as rules  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_run_against_brute_force(spark):
    from corpus_pipeline import run
    from oosgauge.llm.queries import MIX
    from oosgauge.llm.secret_scan import redacted, scan

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    counts = [rules.brute(d[1] or "") for d in docs]  # with 87 labels no cutoff can be proved
    docs = [d for d, (n, _, _, _, rep, *_) in zip(docs, counts) if n >= 50 and 100 * rep <= 50 * n]
    docs = [d for d, (_, _, least) in zip(sorted(docs), sorted(near.brute([d[:2] for d in docs]), key=lambda r: r[0])) if d[0] == least]
    dirty = {d for d, _ in leaks.brute([d[:2] for d in docs], items)}
    docs = [(d, redacted(t, scan(t, t.encode())), lang, src) for d, t, lang, src in docs if d not in dirty]
    rows = [(d, (f"domain{int(src[3:]) // 5}", lang, src), len(t.split())) for d, t, lang, src in docs]
    want = [r for r in mixes.brute(rows, MIX) if r[-1] > 0]
    assert len(want) > 20
    assert sorted((tuple(r) for r in run(spark, SF).collect()), key=str) == want
