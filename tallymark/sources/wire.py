"""The wire format of protocol buffers, read without a schema: fields of a message by number."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of the fixed-width wire types.
_FIXED = {1: 8, 5: 4}


class WireError(ValueError):
    """A message that ends early, or holds a number or a wire type that can't be."""


def _number(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it) of a number in groups of seven bits, the lowest first: ten bytes and 64 bits at most."""
    end = at
    while end < len(data) and data[end] > 0x7F and end - at < 10:
        end += 1
    if end == len(data):
        raise WireError("truncated number")
    value = sum((b & 0x7F) << 7 * k for k, b in enumerate(data[at : end + 1]))
    if end - at > 9 or value >> 64:
        raise WireError("number overflow")
    return value, end + 1


def fields(data: bytes) -> Iterator[tuple[int, int | bytes | None]]:
    """(field number, value): a whole number, bytes (texts and nested messages), or None for fixed-width values, which no reader here asks for.

    Groups and other wire types are rejected, as is a field number of zero or of more than 32 bits.
    """
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        number, kind = tag >> 3, tag & 7
        if not 0 < number <= 0xFFFFFFFF:
            raise WireError("field number out of range")
        if kind == 0:
            value, at = _number(data, at)
            yield number, value
            continue
        if kind == 2:
            size, at = _number(data, at)
        elif kind in _FIXED:
            size = _FIXED[kind]
        else:
            raise WireError("unsupported wire type")
        if size > len(data) - at:
            raise WireError("truncated value")
        yield number, data[at : at + size] if kind == 2 else None
        at += size


class Message:
    """The fields of a message: of repeated numbers and texts the last counts, of nested messages the first."""

    def __init__(self, data: bytes) -> None:
        self.numbers: dict[int, int] = {}
        self.parts: dict[int, list[bytes]] = {}
        for number, value in fields(data):
            if isinstance(value, int):
                self.numbers[number] = value
            elif value is not None:
                self.parts.setdefault(number, []).append(value)

    def count(self, number: int) -> int:
        """A whole number, 0 if it isn't there; no more than a signed 64-bit number holds."""
        return min(self.numbers.get(number, 0), 2**63 - 1)

    def text(self, number: int) -> str | None:
        """A text that isn't blank and is valid UTF-8."""
        try:
            value = self.parts.get(number, [b""])[-1].decode()
        except UnicodeDecodeError:
            return None
        return value if value.strip() else None

    def inner(self, number: int) -> Message | None:
        return Message(self.parts[number][0]) if number in self.parts else None

    def every(self, number: int) -> list[Message]:
        return [Message(p) for p in self.parts.get(number, [])]


def millis(m: Message | None) -> int | None:
    """Epoch ms of a timestamp message: seconds (1) and nanoseconds (2); null if it has no positive time."""
    seconds = m.numbers.get(1, 0) if m else 0
    if not 0 < seconds < 2**63:
        return None
    return min(seconds * 1000 + min(m.numbers.get(2, 0), 999_999_999) // 1_000_000, 2**63 - 1)
