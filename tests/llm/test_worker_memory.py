"""What Python workers hold while a batch is read and keep once a task has ended."""

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from frayline.llm import bpe_prefix, language_id


def test_tables_of_encoded_texts_go_with_their_task(spark, odd_docs):
    def held(batches):
        for batch in batches:
            found = [len(t._pieces) + len(t._spans) + len(t.encoder._pairs) for t in bpe_prefix._tables.values()]
            yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64()), pa.array([sum(found)], pa.int64())], ["n", "entries"])

    docs = odd_docs.repartition(8, F.rand(1))
    done = bpe_prefix.bpe_encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, blank_starts=True)
    assert done.where("n_tokens > 0").count() > 10
    got = spark.range(0, 8, 1, 8).mapInArrow(held, "n long, entries long").collect()
    assert any(r.n for r in got) and not any(r.entries for r in got)


def test_languages_need_no_second_copy_of_a_batch(spark):
    texts = pa.array([f"Some Words of text {i} " * 200 for i in range(4000)])
    before, most, at = pa.total_allocated_bytes(), 0, 0
    for first, lang, _ in language_id._predicted(None, texts):
        assert first == at
        most, at = max(most, pa.total_allocated_bytes() - before), at + len(lang)
    assert at == len(texts) and most < texts.nbytes / 4
