"""The pipeline's stages, each against a brute-force version on its own input, and the whole run."""

from __future__ import annotations

import importlib.util
import re
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import containment_brute, ids_of, jaccard_brute

import corpus_pipeline
from srcatlas.llm import queries as llm_queries
from srcatlas.llm import toxicity
from srcatlas.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.append(written(stage(spark, docs[-1], SF), "stage"))
        assert docs[-1].columns == docs[0].columns, name
    return [{r.doc_id: r for r in d.collect()} for d in docs]


def test_toxicity_stage(spark, steps):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))

    def score(text: str) -> float:
        words = {w for w in re.findall(rb"[0-9a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))}
        hit = {k for w in words for k in keys(w)}
        return 1 / (1 + np.exp(-(sum(float(model.weights[k]) for k in hit) + model.bias)))

    def keys(w: bytes):
        # A word alone in a batch has the same slots as in a text.
        import pyarrow as pa

        from srcatlas.llm.textvec import Words

        return set(toxicity.slots(Words(pa.array([w.decode("utf-8", "surrogateescape")])))[1].tolist())

    some = sorted(steps[0])[:40]
    kept = {i for i in some if score(steps[0][i].text) < 0.7}
    assert kept == {i for i in some if i in steps[1]}
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in steps[1] for i in clean) >= 0.98 * len(clean)


def test_line_stage_keeps_every_document(steps):
    assert set(steps[1]) == set(steps[2])
    for i, r in steps[2].items():
        assert not Counter(r.text.split("\n")) - Counter(steps[1][i].text.split("\n")) or r.text == ""
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (steps[1][i].lang, steps[1][i].source)


def test_near_copy_stage(steps):
    groups = jaccard_brute([(i, r.text) for i, r in steps[2].items()])
    assert sorted(steps[3]) == sorted(map(min, groups))
    assert all(steps[3][i] == steps[2][i] for i in steps[3])


def test_leak_stage(spark, steps):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    leaks = {i for i, _ in containment_brute([(i, r.text) for i, r in steps[3].items()], items)}
    assert set(steps[4]) == set(steps[3]) - leaks


def test_whole_run(spark, steps):
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.sequence_id, r.offset))
    flat = np.concatenate([ids_of(steps[4][i].text, 1) for i in sorted(steps[4])])
    assert b"".join(bytes(r.ids) for r in got) == flat.tobytes()
    assert [r.sequence_id * 2048 + r.offset for r in got] == np.cumsum([0, *(r.length for r in got)])[:-1].tolist()


def test_the_rest_works_without_these_folders(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    (tmp_path / "srcatlas").mkdir()
    for p in (root / "srcatlas").iterdir():
        if p.name != "llm":
            (tmp_path / "srcatlas" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries()); assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp", "PYTHONPATH": ""} | {k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "SPARK", "LD_"))})
    assert importlib.util.find_spec("srcatlas.llm")


def test_names_of_results_may_be_taken(spark, tmp_path):
    """Columns called as results are, in any case, pass through the toxicity stage, and op2 does not read them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("*", "1 AS Score", "'x' AS PREDICTED", "2 AS N_removed_lines")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() <= 60
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert llm_queries.queries()["op2_line_dedup"](spark, str(tmp_path)).columns == ["doc_id", "text", "n_chars", "n_removed_lines"]
