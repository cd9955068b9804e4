"""Token counts by ``word_punct`` or by the tokenizer of a model."""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import token_count

WORD_PUNCT_NAME = "word_punct"
#: Environment variable that names a folder of tokenizer files.
FOLDER = "DOCWEAVE_TOKENIZERS"


def tokenizer_file(name: str) -> str:
    """The file of a tokenizer: ``name`` if it is a file, else ``name.json`` in the folder of the environment; nothing is fetched."""
    folder = os.environ.get(FOLDER)
    for path in (name, *([os.path.join(folder, f"{name}.json"), os.path.join(folder, name, "tokenizer.json")] if folder else [])):
        if os.path.isfile(path):
            return path
    raise FileNotFoundError(f"no tokenizer {name!r}; give a file, or a folder of them in {FOLDER}")


@lru_cache(maxsize=4)
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count(text: Column | str, tokenizer: str = WORD_PUNCT_NAME) -> Column:
    """Tokens of a text, 0 for null; ``word_punct`` inside the JVM, others by Arrow batches of the text alone."""
    if tokenizer == WORD_PUNCT_NAME:
        return token_count(text)
    path = tokenizer_file(tokenizer)

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        encoded = _load(path).encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)
        return pd.Series([len(e.ids) for e in encoded])

    return counted(text)
