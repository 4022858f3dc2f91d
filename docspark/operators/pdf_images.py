"""Images for a PDF: PNG and JPEG files taken as they are, and the size at which they are shown."""

from __future__ import annotations

import struct
from typing import NamedTuple

#: Pixels that an image may have, points of a pixel, EMU of a point.
MOST_PIXELS, PIXEL, EMU = 50_000_000, 0.75, 12_700


class Picture(NamedTuple):
    width: int
    height: int
    looks: str
    data: bytes


def read_picture(data: bytes) -> Picture | None:
    """An image whose compressed data a PDF can hold unchanged, judged by its header before anything else is read.

    PNG without transparency or interlacing, and JPEG in grey or colour; others, and those over MOST_PIXELS, are None.
    """
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:3] == b"\xff\xd8\xff":
            return _jpeg(data)
    except (struct.error, IndexError, KeyError):
        pass
    return None


def _png(data: bytes) -> Picture | None:
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if not 0 < width * height <= MOST_PIXELS or kind not in (0, 2, 3) or interlaced or depth > 8:
        return None
    at, packed, palette = 8, [], b""
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if name == b"IDAT":
            packed.append(body)
        elif name == b"PLTE":
            palette = body
        elif name == b"tRNS":
            return None
        at += 12 + n
    space = {0: "/DeviceGray", 2: "/DeviceRGB", 3: f"[/Indexed /DeviceRGB {len(palette) // 3 - 1} <{palette.hex()}>]"}[kind]
    colors = 3 if kind == 2 else 1
    looks = f"/ColorSpace {space} /BitsPerComponent {depth} /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors {colors} /BitsPerComponent {depth} /Columns {width} >>"
    return Picture(width, height, looks, b"".join(packed)) if packed and (kind != 3 or palette) else None


def _jpeg(data: bytes) -> Picture | None:
    at = 2
    while data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if 0xC0 <= mark <= 0xC2:
            depth, height, width, colors = struct.unpack(">BHHB", data[at + 4 : at + 10])
            if depth != 8 or colors not in (1, 3) or not 0 < width * height <= MOST_PIXELS:
                return None
            return Picture(width, height, f"/ColorSpace {'/DeviceGray' if colors == 1 else '/DeviceRGB'} /BitsPerComponent 8 /Filter /DCTDecode", data)
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def shown_size(picture: Picture, size: tuple[int, int] | None, width: float, height: float) -> tuple[float, float]:
    """Points at which an image is shown: within the size that the document names (in EMU), or its pixels, and within the
    room there is, its shape kept."""
    own = (picture.width * PIXEL, picture.height * PIXEL)
    box = (size[0] / EMU, size[1] / EMU) if size else own
    scale = min(limit / side for limit, side in ((box[0], own[0]), (box[1], own[1]), (width, own[0]), (height, own[1])))
    return own[0] * scale, own[1] * scale


def column_widths(narrow: list[float], natural: list[float], room: float) -> list[float]:
    """Widths of a table's columns in the room there is: natural ones where they fit; else the narrowest, and of what is
    left to each as much as it lacks in proportion; where not even those fit, all scaled down."""
    least, most = sum(narrow), sum(natural)
    if most <= room:
        return list(natural)
    if least >= room:
        return [w * room / least for w in narrow]
    return [a + (b - a) * (room - least) / (most - least) for a, b in zip(narrow, natural)]


def widened(widths: list[float], needed: float) -> list[float]:
    """Widths that are ``needed`` together at least, each widened by the same."""
    lack = max(0.0, needed - sum(widths))
    return [w + lack / len(widths) for w in widths]
