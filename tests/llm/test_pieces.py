"""Pieces cut at changes of kind, frames by block, runs of documents."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from plotwise.llm import frames, textkit, tokens
from plotwise.llm.queries import vocabulary

SIGNS = [*"abcSTDLVMre", "'", "'", "''", *"0129", *".,;!?-_<|>()%$#&*", " ", "\n", "́", "̸", "é", "É", "Σ", "ß", "İ", "ﬁ", "½", "٣", "中", "😀", " ", " ", "\x00", "\x01", "\x1c", "\x85", "'ll", "'re", "it's", "<|endoftext|>", "<|"]


def test_pieces_cut_at_changes_of_kind_give_the_librarys_ids():
    path = vocabulary()
    lib, enc, rng = Tokenizer.from_file(path), tokens.Encoder(path, keep=200), np.random.default_rng(5)
    texts = ["".join(rng.choice(SIGNS, int(rng.integers(0, 40)))) for _ in range(3000)]
    plain = [t.replace("<|", "") for t in texts]  # no block of these falls back to whole pieces
    for rows, size in ((texts, 1), (texts, 200), (texts, 1 << 20), (plain, 1 << 20)):
        at = 0
        for block in textkit.blocks(pa.array(rows), size):
            flat, offsets = enc.block(block)
            for i in range(len(block.rows)):
                assert flat[offsets[i] : offsets[i + 1]].tolist() == lib.encode(rows[at], add_special_tokens=False).ids, rows[at]
                at += 1
        assert at == len(rows)


def test_frames_hold_the_same_bytes_by_document_and_by_block(tmp_path):
    rng = np.random.default_rng(3)
    sizes = np.array([0, 3, 10, 11, 1, 9, 35, 0, 2, 8, 20, 1])
    offsets, flat = np.concatenate([[0], np.cumsum(sizes)]), rng.integers(0, 60_000, sizes.sum()).astype("<u2")
    for name in ("one", "block"):
        writer = frames.FrameWriter(f"file://{tmp_path}/{name}.zst", np.dtype("<u2"), frame_ids=10)
        if name == "one":
            for i in range(len(sizes)):
                writer.add(i, flat[offsets[i] : offsets[i + 1]])
        else:
            writer.add_block(np.arange(5), flat, offsets[:6])
            writer.add_block(np.arange(5, len(sizes)), flat, offsets[5:])
        writer.close()
    assert (tmp_path / "one.zst").read_bytes() == (tmp_path / "block.zst").read_bytes()
    reader = frames.FrameReader(f"file://{tmp_path}/block.zst")
    assert [(d, a, x.tolist()) for d, a, x in reader.read()] == [(i, int(offsets[i]), flat[offsets[i] : offsets[i + 1]].tolist()) for i in range(len(sizes))]
    for ids, docs in ((4, 100), (1, 2), (1000, 3)):
        assert np.concatenate([x for _, _, x in reader.runs(None, ids, docs)]).tolist() == flat.tolist()
    assert [(p, q) for p, q, _ in reader.runs(np.array([1, 2, 5, 11]))] == [(1, 3), (5, 6), (11, 12)]
