import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from segmill.llm.packing import best_fit, pieces_of

from .test_minhash import brute

PARTS = {"aa": ["tha", "ing", "re", "on", "wo"], "bb": ["sch", "ung", "ä", "te", "kei"], "cc": ["ción", "ado", "os", "la", "que"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    word = lambda lang: "".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(360):
        lang = rnd.choice(list(PARTS))
        words = [word(lang) for _ in range(rnd.randint(30, 150))]
        if i % 6 == 0:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grobnik", "vulpak"]))
        docs.append((i, " ".join(words), lang, "s", len(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    clean = [d for d in docs if d[0] % 6]
    docs += [(1000 + k, d[1], d[2], "s", 1) for k, d in enumerate(clean[:20])]  # copies
    docs += [(2000 + k, d[1] + " end", d[2], None, 1) for k, d in enumerate(clean[10:40])]  # near copies
    docs += [(3000, None, "aa", "s", 0), (3001, "", "aa", "s", 0), (3002, "12 34 !", None, None, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        results.append(docs.collect())
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = [{r.doc_id for r in rows} for rows in results]
    assert set(given) - ids[0] == {3000, 3001, 3002}
    gone = ids[0] - ids[1]
    toxic = {i for i in ids[0] if i < 1000 and i % 6 == 0}
    assert len(gone ^ toxic) <= 0.03 * len(ids[0])
    by_text = defaultdict(list)
    for i in ids[1]:
        by_text[given[i]].append(i)
    assert ids[2] == {max(g) for g in by_text.values()}
    assert ids[3] == {i for i, _, _, kept in brute([(i, given[i]) for i in ids[2]], 5) if kept}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i in ids[3]:
        tokens = np.array(library.encode(given[i], add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, s, n, zlib.crc32(tokens[s : s + n].tobytes())) for k, (s, n) in enumerate(pieces_of(len(tokens), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in results[4]) == sorted(want)
    assert len({r.sequence_id for r in results[4]}) <= len(best_fit(np.array([w[3] for w in want]), 2048)[2]) + 1


def test_run_is_the_stages_in_order(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "exact dedup", "MinHash near-dedup", "best-fit packing"]
    assert corpus_pipeline.run(spark, folder).count() > 200


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, str(tmp_path))
        assert got.count() == 0 and (k == 4 or got.columns == corpus_pipeline.COLUMNS)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
