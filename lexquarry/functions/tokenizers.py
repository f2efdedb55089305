"""Tokenizers behind one interface: counts and cuts of a text column by a vocabulary file, or by an estimate."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of files of byte ranks (fixed value: the published pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def coder(content: bytes, kind: str) -> tuple[Callable[[str], list[int]], Callable[[list[int]], str]]:
    """(encode, decode) of a vocabulary file's content, by its kind: 'json' or 'tiktoken'."""
    if kind == "json":
        from tokenizers import Tokenizer

        made = Tokenizer.from_buffer(content)
        made.no_truncation()
        made.no_padding()
        return lambda text: made.encode(text, add_special_tokens=False).ids, lambda ids: made.decode(ids, skip_special_tokens=False)
    if kind == "tiktoken":
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        made = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return made.encode_ordinary, made.decode
    raise ValueError(f"no tokenizer for files of kind {kind!r}")


class Adapter:
    """A tokenizer by its file (.json or .tiktoken), or the estimate where path is None. The file is read on the driver and travels with the plan."""

    def __init__(self, path: str | None = None):
        self.kind = None if path is None else path.rsplit(".", 1)[-1]
        self.content = b""
        if path is not None:
            with open(path, "rb") as f:
                self.content = f.read()
            coder(self.content, self.kind)  # an unknown kind fails here, not in a task

    def count(self, text: Column) -> Column:
        """Tokens of a text; null and empty texts have none."""
        if self.kind is None:
            n = F.length(F.coalesce(text, F.lit("")))
            return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")
        content, kind = self.content, self.kind

        @F.arrow_udf("bigint")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode, _ = coder(content, kind)
            for b in batches:
                yield pa.array([len(encode(t)) if t else 0 for t in b.to_pylist()], pa.int64())

        return counted(text)

    def truncate(self, text: Column, limit: int) -> Column:
        """The text of the first limit tokens; texts that have no more stay as they are."""
        if self.kind is None:
            return F.left(text, F.lit(4 * limit))
        content, kind = self.content, self.kind

        @F.arrow_udf("string")
        def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode, decode = coder(content, kind)
            for b in batches:
                ids = [encode(t) if t else [] for t in b.to_pylist()]
                yield pa.array([decode(i[:limit]) if len(i) > limit else t for i, t in zip(ids, b.to_pylist(), strict=True)], pa.string())

        return cut(text)
