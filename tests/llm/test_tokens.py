"""Words made distinct give the same ids as whole texts; coded blocks and frames give back what went in."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from voxtally.llm.coder import decode_blocks, encode_blocks  # noqa: E402
from voxtally.llm.token_files import build_frame, read_frame  # noqa: E402
from voxtally.llm.tokens import word_tokenizer  # noqa: E402

PARTS = ["a", "B", "the", " ", " ", "\n", "  ", "é", "ß", "İ", "Σ", "́", "<|endoftext|>", "'s", "12", "!", "\t", "漢", " ", "ñ", "\r\n", "don't", "\x1c", "\x85", " "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.text(max_size=20)), max_size=12))
def test_ids_equal_whole_texts(name, texts):
    words = word_tokenizer(public_tokenizers.path(name))
    ids, offsets = words.encode(pa.array(texts, pa.string()))
    want = [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**17), max_size=300), st.integers(1, 40))
def test_blocks_round_trip(ids, block):
    ids = np.array(ids, np.int64)
    payloads, crcs = encode_blocks(ids, block)
    lengths = [min(block, len(ids) - block * k) for k in range(len(payloads))]
    assert decode_blocks(payloads, lengths, crcs).tolist() == ids.tolist()
    for k, payload in enumerate(payloads):  # every block can be read alone
        assert decode_blocks([payload], [lengths[k]], [crcs[k]]).tolist() == ids[k * block : k * block + lengths[k]].tolist()


def test_predictable_ids_get_small_and_damage_is_found():
    ids = np.tile(np.arange(50), 400)
    payloads, crcs = encode_blocks(ids, 4096)
    assert sum(map(len, payloads)) * 8 < 2 * len(ids)
    lengths = [min(4096, len(ids) - 4096 * k) for k in range(len(payloads))]
    hurt = bytearray(payloads[1])
    hurt[len(hurt) // 2] ^= 4
    with pytest.raises(ValueError):
        decode_blocks([payloads[0], bytes(hurt), *payloads[2:]], lengths, crcs)


def test_frame_round_trip():
    names = pa.array([None, 3, 2**62], pa.int64())
    lengths, ids = np.array([1, 5, 2]), np.arange(8) * 5000
    back, n, got = read_frame(build_frame(names, lengths, ids, 3))
    assert back.to_pylist() == [None, 3, 2**62] and n.tolist() == [1, 5, 2] and got.tolist() == ids.tolist()
    with pytest.raises(ValueError):
        read_frame(b"JUNK" + build_frame(names, lengths, ids, 3)[4:])
