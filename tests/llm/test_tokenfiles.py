import glob
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from helpers import SCHEMA, clashing, frame, rows
from tokenizers import Tokenizer

from claimspark.llm import tokenfiles
from claimspark.llm.common import scratch_path
from claimspark.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def test_pieces_give_the_ids_of_the_whole():
    whole, e, r = Tokenizer.from_file(PATH), tokenfiles.Encoder(PATH, known=500), random.Random(5)
    parts = ["a", "b", "The", "é", " ", "  ", "\n", "\t", ".", ",", "'s", "1", "23", "世", "😀", " ", "\u0085", "\x1c", "<|endoftext|>", "!", "?", "-", "\r\n", "word", "re"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip(spark):
    path = scratch_path(spark, "test-tokens")
    got = tokenfiles.round_trip(clashing(frame(spark)), PATH, path).collect()
    whole = Tokenizer.from_file(PATH)
    docs = sorted(((i, t or "") for i, t, *_ in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want, at = [], 0
    for i, t in docs:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_files_are_laid_out_as_told(spark):
    path = scratch_path(spark, "test-layout")
    tokenfiles.write(frame(spark), path, PATH)
    for f in glob.glob(path.removeprefix("file://") + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                used = set(column.encodings)
                assert column.has_column_index and column.has_offset_index
                assert "RLE_DICTIONARY" in used if "ids" in column.path_in_schema else "DELTA_BINARY_PACKED" in used
    plan = tokenfiles.index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<part:int,n_tokens:bigint>" in plan


def test_empty(spark):
    assert tokenfiles.round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0
