"""Slides of a presentation file, read part by part from its package; media are weighed and measured but never unpacked whole."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from xml.etree import ElementTree

MEDIA_TYPE = "array<struct<name:string,kind:string,bytes:long,width:int,height:int,crc:long,unmapped:boolean>>"
# Media by extension, signs of a timer in a name, and the parts whose pictures are template art.
KINDS = {"image": ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff"), "audio": ("mp3", "wav", "m4a", "ogg"), "video": ("mp4", "mov", "avi", "webm", "mkv", "m4v", "wmv")}
TIMER = ("timer", "1min", "countdown")
TEMPLATES = ("ppt/slideLayouts/", "ppt/slideMasters/", "ppt/theme/", "ppt/notesMasters/", "ppt/handoutMasters/")
#: Seconds of a slide's timer, and bytes of a picture that are read to find its size.
SECONDS, HEAD = 60, 65_536


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def cleaned(text: str) -> str:
    """Vertical tabs and all line ends as line feeds, no zero-width characters, plain spaces, trimmed."""
    return re.sub(r"\r\n?|\x0b", "\n", text).replace("​", "").replace("﻿", "").replace("\xa0", " ").strip()


def _text(node: ElementTree.Element) -> str:
    """The paragraphs below a node, a line each."""
    lines = []
    for p in (n for n in node.iter() if _tag(n) == "p"):
        lines.append("".join((n.text or "") if _tag(n) == "t" else "\n" if _tag(n) == "br" else "" for n in p.iter()))
    return cleaned("\n".join(lines))


def _shapes(node: ElementTree.Element, deep: bool = True):
    """Shapes of a tree in order; those of a group stand for the group."""
    for child in node:
        kind = _tag(child)
        if kind == "grpSp" and deep:
            yield from _shapes(child)
        elif kind in ("sp", "pic", "graphicFrame", "cxnSp", "grpSp"):
            yield child


def _first(node: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((n for n in node.iter() if _tag(n) == name), None)


def _name(shape: ElementTree.Element) -> str:
    own = _first(shape, "cNvPr")
    return (own.get("name") or "").lower() if own is not None else ""


def measured(head: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, BMP or JPEG by its first bytes."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 <= len(head):
        mark = head[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", head[at + 5: at + 9])
            return w, h
        at += 2 + int.from_bytes(head[at + 2: at + 4], "big")
    return None


class Package:
    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.info = {i.filename: i for i in self.zip.infolist() if not i.is_dir()}

    def xml(self, name: str) -> ElementTree.Element | None:
        return ElementTree.fromstring(self.zip.read(name)) if name in self.info else None

    def targets(self, part: str) -> list[tuple[str, str]]:
        """(id, part) of what a part points to inside the package, in order."""
        rels = self.xml(posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels"))
        out = []
        for r in rels if rels is not None else ():
            goal = r.get("Target") or ""
            if r.get("TargetMode") != "External" and goal:
                out.append((r.get("Id") or "", goal.lstrip("/") if goal.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), goal))))
        return out

    def slides(self) -> list[str]:
        """Slide parts in the order of the presentation; by number where it names none."""
        main, by_id = self.xml("ppt/presentation.xml"), dict(self.targets("ppt/presentation.xml"))
        ids = [next((v for k, v in n.attrib.items() if k.endswith("}id")), None) for n in main.iter() if _tag(n) == "sldId"] if main is not None else []
        named = [by_id[i] for i in ids if by_id.get(i) in self.info]
        numbered = sorted((int(m[1]), n) for n in self.info if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        return named or [n for _, n in numbered]

    def media(self, part: str, unmapped: bool = False) -> dict | None:
        info, ext = self.info.get(part), part.rsplit(".", 1)[-1].lower()
        if info is None or not info.file_size:
            return None
        kind = next((k for k, exts in KINDS.items() if ext in exts), "other")
        size = None
        if kind == "image":
            with self.zip.open(info) as f:
                size = measured(f.read(HEAD))
        return {"name": posixpath.basename(part), "kind": kind, "bytes": info.file_size, "width": size and int(size[0]), "height": size and int(size[1]), "crc": info.CRC, "unmapped": unmapped}


def slides(content: bytes) -> list[dict]:
    """A row for each slide in the order of the presentation.

    Texts are those of its shapes, groups and tables, each once; a row of a table is its cells with bars between them. A slide with a timer, by a shape's or a video's name, has no
    videos. What no slide and no template points to is filed under the first slide.
    """
    pack = Package(content)
    parts, rows, seen = pack.slides(), [], set()
    for number, part in enumerate(parts, 1):
        root = pack.xml(part)
        tree = _first(root, "spTree")
        tree = root if tree is None else tree
        title, chunks, star = None, [], False
        for s in _shapes(tree):
            place, form = _first(s, "ph"), _first(s, "prstGeom")
            star |= "star" in _name(s) or (form is not None and (form.get("prst") or "").startswith("star"))
            body, grid = _first(s, "txBody"), _first(s, "tbl")
            if _tag(s) == "sp" and body is not None:
                text = _text(body)
                if place is not None and place.get("type") in ("title", "ctrTitle") and title is None:
                    title = text
                chunks.append(text)
            elif grid is not None:
                lines = [" | ".join(_text(c) for c in row if _tag(c) == "tc") for row in grid if _tag(row) == "tr"]
                chunks.append("\n".join(lines).strip())
        timer = any(t in _name(s) for s in _shapes(tree, deep=False) for t in TIMER)
        chunks = list(dict.fromkeys(c for c in chunks if c))
        goals = [g for _, g in pack.targets(part)]
        notes = next((pack.xml(g) for g in goals if "/notesSlides/" in f"/{g}" and g in pack.info), None)
        said = [_text(s) for s in _shapes(_first(notes, "spTree")) if (p := _first(s, "ph")) is not None and p.get("type") == "body"] if notes is not None and _first(notes, "spTree") is not None else []
        items: list[dict] = []
        for g in dict.fromkeys(g for g in goals if "/media/" in g):
            seen.add(g)
            item = pack.media(g)
            if item is None or item["name"] in {i["name"] for i in items}:
                continue
            if item["kind"] == "video" and (timer or any(t in item["name"].lower() for t in TIMER)):
                timer = True
                continue
            items.append(item)
        rows.append({
            "slide_number": number, "title": title or (chunks[0] if chunks else f"Slide {number}"), "extracted_text": "\n\n".join(chunks), "speaker_notes": said[0] if said else "", "has_timer": timer,
            "timer_seconds": SECONDS if timer else None, "has_star_shape": star, "shape_count": sum(1 for _ in _shapes(tree, deep=False)), "media": items, "error": None,
        })
    if rows:
        art = {g for n in pack.info if n.startswith(TEMPLATES) and n.endswith(".xml") for _, g in pack.targets(n)}
        loose = sorted(n for n in pack.info if n.startswith("ppt/media/") and n not in seen and n not in art)
        rows[0]["media"] = rows[0]["media"] + [m for n in loose if (m := pack.media(n, unmapped=True))]
    return rows
