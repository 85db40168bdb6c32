"""Added tokens inside texts, against the library as it is called by default."""

import numpy as np
import pytest

from quillon.llm import packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y  <|endoftext|>\n\nz", "<|endoftext |> <|endoftex", "w\u00e9 <|endoftext|>'ll",
         " ".join(f"word{'<|endoftext|>' if i % 9 == 0 else ''} and <|endoftext|> then" for i in range(4000)), "a b c " * 10921 + "<|endoftext|>" + " d e" * 20000]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_packed_ids_are_those_of_the_library_by_default(spark, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    got = packing.pack(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1), path).toPandas()
    for i, text in enumerate(TEXTS):
        own = got[got.doc_id == i].sort_values("start")
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(own.ids), dtype="<u4").tolist() == [*ids, packing.END_ID] and set(own.doc_tokens) == {len(ids) + 1}
    assert library.encode(TEXTS[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
