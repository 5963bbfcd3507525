"""SHA-256 whose state can be handed from one task to the next, which ``hashlib`` does not offer."""

from __future__ import annotations

import ctypes
import ctypes.util
from functools import cache


@cache
def _library() -> ctypes.CDLL:
    name = ctypes.util.find_library("crypto")
    if name is None:
        import _hashlib  # the library that hashlib itself is linked with

        name = _hashlib.__file__
    return ctypes.CDLL(name)


class Sha256:
    """``state`` is what OpenSSL keeps of the bytes so far, and holds on any machine of the same byte order."""

    def __init__(self, state: bytes | None = None):
        self._context = ctypes.create_string_buffer(state or bytes(112), 112)  # SHA256_CTX
        if state is None:
            _library().SHA256_Init(self._context)

    def update(self, data: bytes) -> Sha256:
        _library().SHA256_Update(self._context, data, ctypes.c_size_t(len(data)))
        return self

    @property
    def state(self) -> bytes:
        return self._context.raw

    def hexdigest(self) -> str:
        digest, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state, 112)
        _library().SHA256_Final(digest, last)
        return digest.raw.hex()
