"""What Python workers keep between tasks."""

import os

import pyarrow as pa
import public_tokenizers

from scholia.llm import common, tokens


def _run(**how):
    return list(common.tidy(lambda batches: (b for b in batches), **how)([1, 2]))


def test_a_vocabulary_goes_when_the_worker_turns_to_another_function():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine = tokens.vocabulary(path, "words")
    assert _run(holds=True) == [1, 2]
    assert tokens.vocabulary(path, "words") is mine  # the next task of its kind finds it
    assert _run() == [1, 2]
    assert not any(common._HELD)
    assert tokens.vocabulary(path, "words") is not mine


def test_texts_come_in_slices_of_half_a_megabyte():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 3000})
    parts = list(common.slices_by_bytes(batch, "text"))
    assert sum(p.num_rows for p in parts) == 3000 and max(p.num_rows for p in parts) <= 525


def test_the_library_encodes_few_texts_at_once_on_one_thread():
    words = tokens.vocabulary(public_tokenizers.path("word_bpe_49k.json"), "words")
    whole, sizes = words.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            sizes.append(len(texts))
            return whole.encode_batch_fast(texts, **how)

    words.tokenizer = Counted()
    try:
        texts = [f"word{i} of some" for i in range(3000)]
        got = words.library(texts)
    finally:
        words.tokenizer = whole
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(sizes) <= tokens.AT_ONCE and os.environ["TOKENIZERS_PARALLELISM"] == "false"
