import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest

from logweave.llm import token_files
from logweave.llm.token_files import Encoder, SeekableReader, SeekableWriter, token_output, write_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  a", "a  b", "a b ", "foo<|endoftext|> bar", "x <|endoftext|> y", "a b c  d e f",
    "é à ñ × ÷ ß", "a\x85 b", "tab\t b", "it's don't I'll", "1 2 33 ½ ² x", "日本 語 テ", "a \n b\n\n c", "\x1c a \x1d b",
    "¿que ¡no", "word " * 5000, "A|b | c || d", "ends with letter é next", "é x",
]


def plain(text):
    return [*Encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_cut_texts_have_the_ids_of_whole_texts():
    got = [ids.tolist() for ids in Encoder(PATH).encode(pa.array(TEXTS))]
    assert got == [plain(t)[:-1] for t in TEXTS]


def test_words_met_often_stay_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 40)
    monkeypatch.setattr(token_files, "ENCODE_BYTES", 200)
    encoder, sent = Encoder(PATH), []
    encode = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: sent.extend(texts) or encode(texts))
    rare = ["".join(chr(97 + int(d)) for d in str(i * 7919)) for i in range(300)]
    texts = [f"It was often seen q{a} z{a}" for a in rare]
    assert [ids.tolist() for ids in encoder.encode(pa.array(texts))] == [plain(t)[:-1] for t in texts]
    assert len(encoder.known) < 100
    assert sum(t.count(" often") for t in sent) == 1


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(token_files, "hash", lambda word: len(word) % 3, raising=False)
    encoder = Encoder(PATH)
    for _ in range(2):
        assert [ids.tolist() for ids in encoder.encode(pa.array(TEXTS))] == [plain(t)[:-1] for t in TEXTS]


def test_round_trip_of_a_file_and_damage(tmp_path):
    store = pyarrow.fs.LocalFileSystem()
    docs = [(7, np.array([1, 2, 50256], np.uint32)), (None, np.zeros(0, np.uint32)), (9, np.arange(5000, dtype=np.uint32))]
    with store.open_output_stream(f"{tmp_path}/a.zst", compression=None) as out:
        writer = SeekableWriter(out, 2)
        for doc, ids in docs:
            writer.add(doc, ids)
        writer.close()
    with store.open_input_file(f"{tmp_path}/a.zst") as file:
        reader = SeekableReader(file)
        assert reader.ids == [7, None, 9]
        assert [reader.document(k).tolist() for k in (2, 0, 1)] == [docs[k][1].tolist() for k in (2, 0, 1)]
    raw = bytearray((tmp_path / "a.zst").read_bytes())
    raw[8] ^= 255
    (tmp_path / "b.zst").write_bytes(raw)
    with store.open_input_file(f"{tmp_path}/b.zst") as file:
        reader = SeekableReader(file)
        assert reader.document(2).tolist() == docs[2][1].tolist()
        with pytest.raises(Exception):
            reader.document(0)


def test_documents_in_order_with_nulls_and_repeated_ids(spark, tmp_path):
    rows = [(i * 7 % 23, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again", "y"), (3, "again", "y"), (None, "no id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Start string").repartition(4)
    got = sorted(token_output(df, PATH, 2).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = sorted((str(i), len(plain(t)), zlib.crc32(np.array(plain(t), "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want


def test_empty_table_writes_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert write_token_files(none, PATH, f"file://{tmp_path}/x", 2).count() == 0
    assert token_output(none, PATH, 2, f"file://{tmp_path}/x").count() == 0
