import hashlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline as cp
import pytest
from llm_helpers import DOCS, docs, frame, rows, rows_of  # noqa: F401
from test_dedup import brute_classes, brute_substring
from test_tokens import check_packing

from leafwise.llm import line_clean
from leafwise.llm.packing import SEQUENCE

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def sf_dir(docs, tmp_path_factory):  # noqa: F811
    folder = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages_are_the_ordered_five():
    assert [name for name, _ in cp.STAGES] == ["quality rules", "language ID", "near-duplicates", "substring dedup", "packing"]


def test_every_stage_takes_effect(spark, docs, sf_dir):  # noqa: F811
    kept = cp.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    want = {r.doc_id: r.clean_text for r in line_clean.clean_lines(docs).filter("kept").collect()}
    assert {r.doc_id: r.text for r in kept.collect()} == want and all(r.n_chars == len(r.text) for r in kept.collect())
    known = cp.language(spark, kept, sf_dir)
    assert known.columns == docs.columns and {r.doc_id for r in known.collect()} == set(want) - {206, 207}
    unique = cp.near_duplicates(spark, known, sf_dir)
    held = [tuple(r) for r in known.collect()]
    classes = brute_classes(held)
    assert sorted(rows_of(unique)) == sorted(r for r in held if classes[r[0]] == r[0])
    cut = cp.substrings(spark, unique, sf_dir)
    assert cut.columns == docs.columns
    got = {r.doc_id: hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() for r in cut.collect()}
    assert got == {d: digest for d, _, _, digest in brute_substring(rows_of(unique), 13)}
    packed = cp.pack(spark, cut, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(got)
    assert check_packing(packed, SEQUENCE) <= sum(r.length for r in packed) // SEQUENCE + 2


def test_documents_without_any_language_go_on(spark, sf_dir):
    rows = [(1, "the bright river and the stone", None), (2, "der Winter und die Straße", None)]
    blank = spark.createDataFrame([(i, text, lang, "s", len(text)) for i, text, lang in rows], DOCS)
    assert sorted(rows_of(cp.language(spark, blank, sf_dir))) == sorted(rows_of(blank))


def test_run_applies_all_stages(spark, sf_dir, tmp_path):
    found = cp.run(spark, sf_dir).collect()
    assert found and check_packing(found, SEQUENCE)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_entry_works_without_these_modules(tmp_path):
    """The other queries stay when the pipeline and this package are deleted."""
    import shutil

    shutil.copytree(ROOT / "leafwise", tmp_path / "leafwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("False"), out.stderr[-1500:]
    assert int(out.stdout.split()[0]) > 140
