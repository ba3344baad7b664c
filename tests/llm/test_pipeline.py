import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from aerostrata.llm import quality
from aerostrata.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.compare import compare, connect
from tests.llm import brute
from tests.llm.test_hmm_quality import labelled_corpus

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_matches_brute_force(spark, docs_of, tmp_path):
    docs, labels = labelled_corpus(21, 150)
    shared = docs[1][1]
    docs += [(1000 + i, shared + f" tail{i} and some more words") for i in range(5)]
    docs += [(1100, docs[7][1] + "\n" + docs[8][1]), (1101, docs[7][1] + "\n" + shared), (1102, None), (1103, "")]
    folder = str(tmp_path)
    docs_of(docs).write.parquet(f"{folder}/documents.parquet")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table.write.parquet(f"{folder}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), table)
    keys = [model.weight(t)[1] + quality.gumbel(d, t) for d, t in docs]
    k = model.good(len(keys), sum(x >= model.cut for x in keys))
    now = [row for row, x in zip(docs, keys) if k and x >= sorted(keys, reverse=True)[k - 1]]
    assert len(now) < len(docs)
    now = [(d, k) for (d, _), k in zip(now, brute.lines_kept(now))]
    now = brute.one_of_each(now)
    now = [(d, t if len(k) == len(brute.words(t)) else " ".join(k)) for (d, t), k in zip(now, brute.windows_kept(now))]
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for d, t in now:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            own = np.array(ids[p:p + 4096], "<u4")
            want.append((d, p // 4096, p, len(own), zlib.crc32(own.tobytes())))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4096)


def test_all_but_the_last_stage_return_the_columns_of_documents(spark, docs_of, tmp_path):
    docs, labels = labelled_corpus(22, 40)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = docs_of(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), QUERIES[name], ORACLE_SQL[name], folder) is None


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
