"""Chunks of source files, for a look at their borders: ``python -m sonde.dump FILE...``."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

from .operators.chunking import chunk_source
from .sources.syntax import provider_for
from .sources.walk import grammar


def dump(path: str, shown: int = 200) -> Iterator[str]:
    """Lines of text: the file, its language and provider, and each chunk with its place, a hash and its beginning."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    language = grammar(path)
    provider = provider_for(language)
    chunks = chunk_source(source, provider.parse(source))
    yield f"{path}: {language}, read by {type(provider).__name__}, {len(source.encode())} bytes, {len(chunks)} chunks"
    for n, (first, last, start, end, content, kind, definition) in enumerate(chunks):
        digest = hashlib.md5(content.encode()).hexdigest()[:12]
        yield f"#{n} lines {first}-{last}, bytes {start}-{end}, md5 {digest}, {kind}{', definition' if definition else ''}"
        yield content if len(content) <= shown else f"{content[:shown]}..."


if __name__ == "__main__":
    if len(sys.argv) < 2:
        sys.exit("usage: python -m sonde.dump FILE...")
    for name in sys.argv[1:]:
        print("\n".join(dump(name)))
