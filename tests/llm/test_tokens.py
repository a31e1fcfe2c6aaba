"""Token counts and token files against the tokenizers library, and exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from modelward.llm import token_counts, token_files  # noqa: E402
from modelward.session import fresh_folder  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"ab  's'tre'll'd \n\t\r\x0b\x1c\x1f\x85\xa0 09½²,.!?''--éßЖ字😀​　 ", "<|endoftext|>", "'ve", "'re ", "  ", "\n\n", " \n", "aaaa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    return [*made, None, "", "'s", "a''s", "<|endoftext|>", "x" * 600_000, "word's <|endoftext|> " * 60_000]


def test_counts_and_ids_are_the_librarys(library, texts):
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    column = pa.array(texts, pa.string())
    assert token_counts.Counter(PATH)(column).tolist() == [len(w) for w in want]
    got = list(token_files.Encoder(PATH, 2)(column))
    assert all(g.tolist() == [*w, 2] for g, w in zip(got, want)) and len(got) == len(want)


def test_tables_that_fill_up_are_emptied(library, texts):
    counter, encoder = token_counts.Counter(PATH), token_files.Encoder(PATH, 2)
    counter.known, encoder.known = token_counts.Known(8), token_files.Known(8)
    some = texts[:300]
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    assert counter(pa.array(some)).tolist() == [len(w) for w in want]
    assert [g.tolist()[:-1] for g in encoder(pa.array(some))] == want


@pytest.mark.parametrize("values", [[], [0], [2**31, 5, 4095, 4096, 255, 256, 0], list(range(3000)) + [70_000] * 600])
def test_direct_codes_give_any_number(values):
    values = np.array(values, np.int64)
    built = token_files.DirectCodes.built(values)
    read = token_files.DirectCodes.from_bytes(memoryview(built.to_bytes()), len(built.levels))
    assert (read.all() == values).all()
    order = np.random.default_rng(0).permutation(len(values))
    assert (read.at(order) == values[order]).all()


def test_files_hold_all_documents_in_order(corpus, library, odd):
    folder = fresh_folder(corpus, "test_files")
    token_files.write_token_files(odd, folder, PATH, file_tokens=1000)
    rows = token_files.token_starts(token_files.read_token_files(corpus, folder).checkpoint()).orderBy("start").collect()
    docs = sorted(((r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc_id, text) in zip(rows, docs, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_tables(corpus, none):
    assert token_counts.token_counts(none, PATH).count() == 0
    folder = fresh_folder(corpus, "test_files")
    token_files.write_token_files(none, folder, PATH)
    assert token_files.token_starts(token_files.read_token_files(corpus, folder).checkpoint()).count() == 0


def test_odd_rows_are_counted(library, odd):
    got = token_counts.token_counts(odd, PATH).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
