"""Token counts, byte-level BPE and token files against the public libraries."""

import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from estate_spark.llm import byte_bpe, token_counts, token_files
from estate_spark.llm.caches import WordMemo

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("rows", [4, 65_536])
def test_counts_are_the_librarys(spark, edge_docs, edges, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in edges)
    got = token_counts.count_tokens(edge_docs, PIECES, table_rows=rows).collect()
    assert Counter(map(tuple, got)) == want


def test_counts_of_nothing(empty_docs):
    assert token_counts.count_tokens(empty_docs, PIECES).collect() == []


def test_memo_stays_within_its_bound():
    calls = Counter()
    memo = WordMemo(lambda w: calls.update([w]) or len(w), 10, {"fixed": 5})
    for n in range(100):
        assert memo[f"w{n}"] == len(f"w{n}") and len(memo) <= 12
    assert memo["fixed"] == 5 and "fixed" not in calls
    long = "y" * 100
    assert memo[long] == 100 and long not in memo


def test_bpe_ids_are_the_librarys_and_decode_back(edge_docs, edges, tik):
    coded = byte_bpe.decode(byte_bpe.encode(edge_docs, RANKS, PATTERN), RANKS).collect()
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded), r.valid_utf8) for r in coded)
    assert got == Counter((i, tuple(tik.encode_ordinary(t or "")), (t or "").encode(), True) for i, t in edges)
    assert all(len(r.ids) < 4000 for r in coded if r.doc_id == 8)


def test_bpe_of_nothing(empty_docs):
    assert byte_bpe.encode(empty_docs, RANKS, PATTERN).collect() == []


def test_transducer_equals_merges_on_random_bytes():
    machine = byte_bpe.Transducer(byte_bpe.read_ranks(RANKS))
    random = np.random.default_rng(2)
    for size in random.integers(1, 40, 1500):
        data = bytes(random.choice(list("aeionrst hd".encode()) + [0xC3, 0xA9, 0xFF, 0x20], size).tolist())
        want = [machine.ranks[data]] if data in machine.ranks else machine.merges(data)
        assert machine.encode(data) == want


def test_transducer_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STATES", 5)
    monkeypatch.setattr(byte_bpe, "PAIRS", 5)
    machine = byte_bpe.Transducer(byte_bpe.read_ranks(RANKS))
    for word in (" thinnandre", " ouververging", " éléphantesques") * 3:
        assert machine.encode(word.encode()) == machine.merges(word.encode())


@pytest.mark.parametrize("cut", [1, 2, 3, 5])
def test_streaming_decode_never_tears_a_character(cut):
    text = "aé漢🙂ñ" * 50
    data = text.encode()
    pieces = list(byte_bpe.decode_stream(data[i : i + cut] for i in range(0, len(data), cut)))
    assert "".join(pieces) == text and all("�" not in piece for piece in pieces)


def test_broken_bytes_are_told():
    machine = byte_bpe.Utf8Machine()
    assert machine.feed(b"a\xff") + machine.feed(b"\xe6", last=True) == "a��" and not machine.valid


@pytest.fixture
def written(edge_docs, folder):
    return token_files.write_token_files(edge_docs, folder, JSON, PATTERN, end_id=0)


def test_token_files_round_trip(written, edges):
    tokenizer = Tokenizer.from_file(JSON)
    start, want = 0, []
    for i, t in sorted(edges, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = sorted(map(tuple, token_files.read_token_files(written).collect()), key=lambda r: r[1])
    assert [(*r[:4], list(r[4])) for r in got] == want


def test_readers_open_only_the_frames_they_need(tmp_path):
    writer = token_files.FrameWriter(f"{tmp_path}/a.zst", "<u2")
    for key in range(6):
        writer.add(key, np.full(400_000, key))
    writer.close()
    reader = token_files.FrameReader(f"{tmp_path}/a.zst")
    opened = []
    frame = reader.frame
    reader.frame = lambda n: opened.append(n) or frame(n)
    assert [(k, len(v), v[0]) for k, v in reader.documents([3])] == [(3, 400_000, 3)]
    assert len(reader.table) > 2 and len(opened) == 1


def test_a_changed_frame_is_refused(tmp_path):
    writer = token_files.FrameWriter(f"{tmp_path}/a.zst", "<u4")
    writer.add(1, np.arange(1000))
    writer.close()
    data = bytearray((tmp_path / "a.zst").read_bytes())
    data[60] ^= 1
    (tmp_path / "a.zst").write_bytes(data)
    with pytest.raises(Exception):
        list(token_files.FrameReader(f"{tmp_path}/a.zst").documents())
    assert struct.unpack("<I", data[-4:])[0] == token_files.SEEK_MAGIC


def test_token_files_of_nothing(empty_docs, folder):
    assert token_files.read_token_files(token_files.write_token_files(empty_docs, folder, JSON, PATTERN)).collect() == []


def test_pairs_stay_apart_as_the_definition_says():
    machine = byte_bpe.Transducer(byte_bpe.read_ranks(RANKS))
    text = "straße 漢字 naïve d0c9f1e2 internationalisation aaaaaaaa    x\n\n".encode()
    tokens = sorted({rank for token, rank in machine.ranks.items() if token in text})
    for left in tokens:
        for right in tokens[::3]:
            pair = machine.token[left], machine.token[right]
            assert machine.stay_apart(*pair) == (machine.merges(b"".join(pair)) == [left, right])


def test_long_matches_are_traced_as_short_ones(monkeypatch):
    machine = byte_bpe.Transducer(byte_bpe.read_ranks(RANKS))
    data = b"abracadabra0123zzyx" * 40
    whole = machine.encode(data)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 3)
    assert machine.encode(data) == whole == machine.merges(data)
