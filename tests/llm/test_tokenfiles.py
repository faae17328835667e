import random
import zlib

import numpy as np
import pyarrow as pa

from tracegraph.llm import tokenfiles as T

from .conftest import ODD


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.default_tokenizer())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_tokenizer_on_whole_texts():
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "'s", "12", ".", "é", " ", "\x1c", "\x85", "<|endoftext|>", "日"]) for _ in range(rng.randrange(60))) for _ in range(4000)]
    encoder = T.Encoder(T.default_tokenizer())
    for part in (texts, [t for t in texts if "  " not in t and "\t" not in t], texts[5:9], []):
        ids, sizes = encoder.encode(pa.array(part, pa.string()).slice(0))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])][: len(part)] == plain(part)
        ids, sizes = encoder.encode(pa.array(["x", *part], pa.string()).slice(1))
        assert ids.tolist() == [x for y in plain(part) for x in y]


def test_files_give_back_every_id(spark, odd_docs, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    T.write_tokens(odd_docs, folder, length=64)
    rows = T.read_tokens(spark, folder).orderBy("start").collect()
    docs = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0], x[1]))
    start = 0
    for r, (doc_id, text), ids in zip(rows, docs, plain([t for _, t in docs]), strict=True):
        want = np.array([*ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_sequences_are_views_with_masks(spark, odd_docs, tmp_path):
    folder = str(tmp_path / "tokens")
    T.write_tokens(odd_docs.coalesce(1), folder, length=64)
    names = sorted(p.name.removesuffix(".index.arrow") for p in (tmp_path / "tokens").glob("*.index.arrow"))
    for name in names:
        f = T.TokenFile(folder, name)
        before = pa.total_allocated_bytes()
        ids, mask = f.sequence(0)
        assert len(ids) == 64 and len(mask) == 64 and not ids.flags.writeable
        assert pa.total_allocated_bytes() - before < 4096
        total = sum(f.file.get_batch(i).column("mask").flatten().sum().as_py() for i in range(f.file.num_record_batches))
        assert total == sum(f.index.get_batch(i).column("n_tokens").to_numpy().sum() for i in range(f.index.num_record_batches))


def test_added_tokens_as_the_library_encodes_them():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "a <|endoftext b", "plain"]
    ids, sizes = T.Encoder(T.default_tokenizer()).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == plain(texts)
    assert any(50256 in x for x in plain(texts))


def test_files_of_lost_tasks_are_removed(spark, odd_docs, tmp_path):
    folder = tmp_path / "tokens"
    folder.mkdir()
    (folder / "part-000000-lost.arrow").write_text("")
    (folder / "other").write_text("")
    T.write_tokens(odd_docs, str(folder), length=64)
    assert not (folder / "part-000000-lost.arrow").exists() and (folder / "other").exists()
    assert T.read_tokens(spark, str(folder)).count() == odd_docs.count()


def test_empty_table(spark, no_docs, tmp_path):
    T.write_tokens(no_docs, str(tmp_path / "none"))
    assert T.read_tokens(spark, str(tmp_path / "none")).count() == 0
