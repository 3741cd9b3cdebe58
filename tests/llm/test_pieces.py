"""SentencePiece encoding and decoding, against the library."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from augmill.llm import pieces
from augmill.llm.pieces import MARK

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def made_texts():
    rng = random.Random(3)
    alphabet = list(" ▁ab\t\nqué日\U0001f600 < >s1\x00") + ["the ", " ing", "  ", "ation"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1_500)]
    return [*texts, "a" * 5_000 + " " * 3_000 + "b" * 100, "ab" * 3_000, " " * 5_000, "<s> a </s> <unk> <0x41>", "a" * pieces.SHORT]


def test_segments_and_texts_equal_the_library(library):
    model = pieces.Pieces(PATH)
    for text in made_texts():
        ids = [i for c in pieces.cut(text) for i in model.segment(MARK + c.replace(" ", MARK))]
        assert ids == library.encode(text)
        assert model.decode(np.array(ids, np.int32), np.array([len(ids)])).to_pylist() == [library.decode(ids)]


def test_any_ids_decode_as_in_the_library(library):
    model, rng = pieces.Pieces(PATH), random.Random(4)
    for batch in range(200):
        lists = [[rng.choice([0, 1, 2, 28705, 259, 264, 5_000, 3 + rng.randrange(256), rng.randrange(32_000)][batch % 3 and 3 :])
                  for _ in range(rng.randint(0, 9))] for _ in range(20)]
        flat = np.array([i for x in lists for i in x], np.int32)
        assert model.decode(flat, np.cumsum([len(x) for x in lists])).to_pylist() == [library.decode(x) for x in lists]


@pytest.mark.parametrize("block,table", [(pieces.BLOCK_CHUNKS, pieces.TABLE_CHUNKS), (400, 300)])
def test_rows_of_all_kinds(spark, docs, odd_rows, library, block, table):
    rows = [*odd_rows, *((100 + k, t) for k, t in enumerate(made_texts()[-200:]))]
    frame = docs(rows).repartition(3)
    got = pieces.decode(pieces.encode(frame, PATH, block=block, table=table), PATH).collect()
    want = sorted((str(i), library.encode(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), r.token_ids) for r in got) == want
    assert all(r.decoded == library.decode(r.token_ids) for r in got)
    both = pieces.encode(frame, PATH, block=block, table=table, decoded=True)
    assert sorted((str(r.doc_id), r.token_ids, r.decoded) for r in both.collect()) == sorted((str(r.doc_id), r.token_ids, r.decoded) for r in got)


def test_empty_table(spark, docs):
    assert pieces.decode(pieces.encode(docs([]), PATH), PATH).collect() == []


def test_a_missing_model_is_refused(docs, tmp_path):
    with pytest.raises(FileNotFoundError):
        pieces.encode(docs([]), str(tmp_path / "none.model"))
