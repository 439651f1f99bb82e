"""SHA-256 whose state can be taken up again, which hashlib doesn't offer."""

from __future__ import annotations

import _hashlib
import ctypes

import pyarrow as pa

#: What OpenSSL's SHA256_CTX holds (openssl/sha.h): eight words of the chain, two of the length, a block of 64 bytes, and two numbers.
_SIZE = 4 * (8 + 2 + 16 + 2)


class Sha256:
    """A chain from its start or from a state, as the library that hashlib itself uses computes it."""

    def __init__(self, state: bytes | None = None) -> None:
        self._lib = ctypes.CDLL(_hashlib.__file__)  # leads to the library it is linked with
        if state is None:
            self._now = ctypes.create_string_buffer(_SIZE)
            self._lib.SHA256_Init(self._now)
        elif len(state) == _SIZE:
            self._now = ctypes.create_string_buffer(state, _SIZE)
        else:
            raise ValueError(f"a state of {len(state)} bytes")

    def update(self, data: bytes | pa.Buffer) -> None:
        if isinstance(data, bytes):
            self._lib.SHA256_Update(self._now, data, ctypes.c_size_t(len(data)))
        elif data.size:
            self._lib.SHA256_Update(self._now, ctypes.c_void_p(data.address), ctypes.c_size_t(data.size))

    def state(self) -> bytes:
        return self._now.raw

    def hexdigest(self) -> str:
        last, out = ctypes.create_string_buffer(self._now.raw, _SIZE), ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(out, last)
        return out.raw.hex()
