"""Chunks of texts: words with a mark need no search for pieces, and a worker keeps one encoder."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import token_files


def test_chunks_equal_the_library_and_words_with_marks_are_not_searched(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = token_files.ChunkEncoder(path, "<u2")
    odd = ["", " ", "a", " a", "a ", "a  b", "a b", "\n x y", "<|endoftext|> a b", "日本 語 x", "it's 12 'll we'll", "a\tb c d", "x a, b. c! d? e; f: ., , a.. A1, é, é x", "b Ångström, naïve. ª, ª"]
    assert coder.encode(odd) == coder._whole(odd) and [coder.encode([t])[0] for t in odd] == coder._whole(odd)
    monkeypatch.setattr(coder.known, "of", lambda text: pytest.fail(f"searched {text}") if text != "x" else b"")
    assert coder.encode(["x zebras, quills. zebras!"])[0] == coder._whole([" zebras, quills. zebras!"])[0]
    assert token_files._coder(path, "<u2") is token_files._coder(path, "<u2")


def test_lines_and_marks_are_put_together_from_words(monkeypatch):
    coder = token_files.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    odd = ["x a.\nB c\n\nd e\n", "x end.\nStart&&&\nnext!? y", "x w'\ns w's\n's it'\n'll", "x é&&&\nÅb  c\x85\nd e\x1c\nf\tg\n\rh", "x \na b\n c", "x a_b\n1,2\n日本\nc __ &\n& a%\n%b", "x 'a'\n\"b\" c\r\nd", "x ª.\nº ß\nÿ ñ'\nñ's"]
    assert coder.encode(odd) == coder._whole(odd) and [coder.encode([t])[0] for t in odd] == coder._whole(odd)
    monkeypatch.setattr(coder.known, "of", lambda text: pytest.fail(f"searched {text}") if text != "x" else b"")
    tail = " quagga.\nZebu%%%\nokapi, tapir&&&"
    assert coder.encode(["x" + tail])[0] == coder._whole([tail])[0]
    assert "quagga." in coder.known and "quagga.\nZebu%%%\nokapi," not in coder.known


def test_chunks_met_lately_are_remembered_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 60)
    coder = token_files.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    asked = []
    made = coder.known.pieces.model

    class Model:
        def tokenize(self, letters):
            asked.append(letters)
            return made.tokenize(letters)

    coder.known.pieces.model = Model()
    names = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(1000, 1200)]
    for i in range(0, 200, 5):
        text = " ".join(["x", "often", *names[i : i + 5]])
        assert coder.encode([text]) == coder._whole([text])
        assert len(coder.known) + len(coder.known.former) <= 60 + 12
    assert sum(a.endswith("often") for a in asked) == 1


def test_each_distinct_chunk_of_texts_is_looked_up_once(monkeypatch):
    coder = token_files.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    texts = ["a b c b", "", "x", " a", "日本 b c", "c  c", "b b b b.\nb <|endoftext|>", "d b c b. b"]
    asked = []
    made = coder.known.__getitem__
    monkeypatch.setattr(coder.known, "__getitem__", lambda chunk: (asked.append(chunk), made(chunk))[1], raising=False)
    assert coder.encode(texts) == coder._whole(texts)
    assert sorted(asked) == ["b", "b.", "c"]


def test_the_counts_of_a_task_come_with_its_last_segment(monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(token_files, "TaskContext", Task)
    monkeypatch.setattr(token_files, "SEGMENT", 8)
    monkeypatch.setattr(token_files, "ENCODED_AT_ONCE", 16)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a b c", None, "", "d " * 40 + "d", "x y z", "é ü", "a b c d e f g"]
    run = token_files._segments(path, "<u2", 0, 60_000)
    for n in range(len(texts) + 1):
        batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array(texts[:n], pa.string())], names=["doc_id", "text"])
        rows = [r for b in run([batch]) for r in b.to_pylist()]
        ids = np.frombuffer(b"".join(r["ids"] for r in rows), "<u2")
        whole = token_files.ChunkEncoder(path, "<u2")._whole([t or "" for t in texts[:n]])
        assert ids.tobytes() == b"".join(x + b"\0\0" for x in whole)
        assert [d for r in rows for d in r["docs"]] == list(range(n))
        assert [r["counts"] is not None for r in rows] == [False] * (len(rows) - 1) + [True] * (n > 0)
        if n:
            assert (np.frombuffer(rows[-1]["counts"], "<i8") == np.bincount(ids, minlength=60_000)).all()


def test_first_chunks_of_lines_are_remembered():
    coder = token_files.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    odd = ["x\ny z", "a b\n日本 c\n語", "a\n b c", "a\x85\nb", "a\x1f\nb", "a\0b c\nd", "\0\nb c", "a \0b\nc", "a \nb c", "ab\nc\nd.\n'll e", "a\n b", "x y\n\nz", "x\n", "\nx", "\n", "a\r\nb c", "a \nb\nc", "é\nà\n'\n''", "日本\n語"]
    assert coder.encode(odd) == coder._whole(odd) and [coder.encode([t])[0] for t in odd] == coder._whole(odd)
    text = "x one.\nTwo three\nfour"
    assert coder.encode([text]) == coder._whole([text])
    assert {"one.", "\0Two", "three", "\0four"} <= set(coder.known)
