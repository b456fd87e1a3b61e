"""SHA-256 that stops after any byte and goes on in another task: OpenSSL's own state, carried as bytes."""

from __future__ import annotations

import ctypes
import hashlib
from functools import cache

#: Room for OpenSSL's state, of which it uses 112 bytes; nothing here looks into it.
_ROOM = 256
_READ = 4 << 20


@cache
def openssl() -> ctypes.CDLL | None:
    """The library that hashlib itself is linked to; none where Python was built without it."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        return library if all(hasattr(library, f"SHA256_{name}") for name in ("Init", "Update", "Final")) else None
    except (ImportError, AttributeError, OSError):
        return None


class Sha256:
    """A SHA-256 that begins anew or from the state that another one had; state() is None where it cannot be carried."""

    def __init__(self, state: bytes | None = None):
        self._whole = None if openssl() else hashlib.sha256()
        self._state = ctypes.create_string_buffer(state or b"", _ROOM)
        if state is None and self._whole is None:
            openssl().SHA256_Init(self._state)

    def update(self, data: bytes) -> None:
        if self._whole is not None:
            self._whole.update(data)
        else:
            openssl().SHA256_Update(self._state, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes | None:
        return None if self._whole is not None else self._state.raw

    def hexdigest(self) -> str:
        if self._whole is not None:
            return self._whole.hexdigest()
        out = ctypes.create_string_buffer(32)
        openssl().SHA256_Final(out, ctypes.create_string_buffer(self._state.raw, _ROOM))
        return out.raw.hex()


def hash_on(path: str, size: int, at: int, state: bytes | None, most: int) -> tuple[int, bytes | None, str | None]:
    """(where it stopped, the state there, the digest at the end) after at most `most` more bytes of a file; without OpenSSL the whole of it in one go, from its begin."""
    at, upto = (at, min(size, at + most)) if openssl() else (0, size)
    digest = Sha256(state if at else None)
    with open(path, "rb", buffering=0) as file:
        file.seek(at)
        while at < upto:
            data = file.read(min(_READ, upto - at))
            if not data:
                raise RuntimeError(f"{path} ends at byte {at}, before the {size} that were listed")
            digest.update(data)
            at += len(data)
    return (at, None, digest.hexdigest()) if at == size else (at, digest.state(), None)
