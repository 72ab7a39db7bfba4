"""The pipeline's stages against brute force."""

import os
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from brindle.catalog import materialize, table
from tests.llm import test_decontam, test_jaccard, test_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "near_copies", "decontamination", "mixture", "token_ids"]
    rows = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == table(spark, SF, "documents").columns
        rows[name] = [r["doc_id"] for r in docs.collect()]
    good = {d for d, t in texts.items() if not test_quality.brute(t)[-1]}
    assert set(rows["quality_rules"]) <= good and len(rows["quality_rules"]) > 0.6 * len(good)
    firsts = {c for _, _, c in test_jaccard.brute([(d, texts[d]) for d in rows["quality_rules"]])}
    assert sorted(rows["near_copies"]) == sorted(firsts)
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    dirty = {r[0] for r in test_decontam.brute([(d, texts[d]) for d in rows["near_copies"]], items) if r[-1]}
    assert sorted(rows["decontamination"]) == sorted(firsts - dirty)
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", texts[d])) for d in rows["decontamination"]}
    mixed = rows["mixture"]
    assert set(mixed) <= set(words) and max(map(mixed.count, set(mixed))) <= 2
    assert abs(sum(words[d] for d in mixed) - 1.5 * sum(words.values())) < 20 * max(words.values()) / 2
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d in sorted(mixed):
        ids = np.array([*tokenizer.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == want


APART = """
import sys
sys.path.insert(0, sys.argv[1])
import public_tokenizers
import __spark_entry__
from brindle.llm import decontam, grammar, jaccard
from brindle.session import local_session
spark = local_session(2, "apart")
docs = spark.createDataFrame([(i, "a b c d e f g h i j %d" % (i // 2)) for i in range(6)], "doc_id long, text string")
print(len({r["component_id"] for r in jaccard.join(docs).collect()}), sum(r["contaminated"] for r in decontam.report(docs, docs.selectExpr("doc_id AS item_id", "text").limit(1)).collect()))
print(jaccard.deduplicate(docs).count(), decontam.clean(docs, docs.selectExpr("doc_id AS item_id", "text").limit(1)).count(), grammar.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).count())
"""


def test_executors_need_no_copy_of_the_code(tmp_path):
    """Workers that start elsewhere, without the repository in their path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", APART, str(Path(__file__).resolve().parents[2])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["3", "6", "3", "0", "6"], done.stderr[-2000:]
