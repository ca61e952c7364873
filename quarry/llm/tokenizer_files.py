"""Where the public tokenizer files lie; operators take the path as a parameter."""

from __future__ import annotations


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
