import struct
import tempfile
import zlib
from collections import Counter

import pyarrow.parquet as pq

from bibliospark.llm.queries import vocabulary
from bibliospark.llm.tokens import Encoder, read_tokens, token_digests, write_tokens


def brute(rows):
    from tokenizers import Tokenizer

    library, start, out = Tokenizer.from_file(vocabulary()), 0, []
    for i, text in sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode())):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_digests_against_the_library(spark, small, small_rows):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    write_tokens(small, path, vocabulary())
    got = [tuple(r) for r in token_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert Counter(got) == Counter(brute(small_rows))
    one = read_tokens(spark, path, 900_005, 900_006).collect()
    assert [r.doc_id for r in one] == [900_005, 900_006] and all(len(r.ids) == r.n_tokens for r in one)


def test_pieces_against_the_library():
    encoder = Encoder(vocabulary(), limit=10)
    letters = [chr(c) for c in range(0xC0, 0x250)]
    for text in [" ".join(c + "a" + c + ".,"[i % 2] for i, c in enumerate(letters)), "don't we'll 'sup it's, a.b!! A.B ÉTÉ é ßẞ ǅ xªºµ ﬁ İ <|startoftext|>x<|endoftext|>..", "a\tb\x0bc d e", "", " ", "\n\n x \n", "12,5% #a##b $$$ Straße.* naïve,'s"]:
        ids, sizes = encoder.encode([text, text], 2)
        want = encoder.library.encode(text, add_special_tokens=False).ids + [2]
        assert ids.tolist() == want * 2 and sizes.tolist() == [len(want)] * 2


def test_encodings_in_the_files(spark, small):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    write_tokens(small, path, vocabulary())
    import glob

    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in sorted(glob.glob(f"{path}/*.parquet"))]
    ids = [g.column(i) for g in groups for i in range(g.num_columns) if g.column(i).path_in_schema == "ids.list.element"]
    assert ids and all("RLE_DICTIONARY" in c.encodings and c.has_column_index for c in ids)
    meta = [g.column(0) for g in groups]
    assert all("DELTA_BINARY_PACKED" in c.encodings for c in meta)


def test_empty(spark, nothing):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    write_tokens(nothing, path, vocabulary())
    assert token_digests(spark, path).count() == 0
