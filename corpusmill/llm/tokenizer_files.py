"""Where the public tokenizer files are; set TOKENIZER_FILES for another folder."""

import os

FOLDER = os.environ.get("TOKENIZER_FILES", "/opt/tokenizers")


def path(name: str) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{FOLDER}/{name}"


BYTE_BPE = path("byte_bpe_50k.json")
PIECES = path("piece_bpe_32k.model")
