"""Where the vocabulary files of public tokenizers lie."""

from __future__ import annotations


def vocabulary(name: str) -> str:
    """The path of a vocabulary file, which every machine of the cluster has at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)
