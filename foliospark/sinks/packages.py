"""Packages with fixed bytes: ZIP archives with a manifest, and PPTX decks.

Entries are in the order of their names with one timestamp, so equal rows give
equal files.  A deck, and a volume of a package, is one file and is made by one task.
"""

from __future__ import annotations

import hashlib
import io
import json
import time
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.packages import MAX_TOTAL

MANIFEST = "MANIFEST.json"
# What a volume of a package holds, about: well under what readers take (``MAX_ENTRIES``, ``MAX_TOTAL``).
VOLUME_ENTRIES, VOLUME_BYTES = 50_000, 32 << 20
_A, _P = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
_R, _TYPES = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/"


def _zip(entries: dict[str, bytes], epoch: int) -> bytes:
    out = io.BytesIO()
    stamp = time.gmtime(max(epoch, 315_532_800))[:6]  # the format starts in 1980
    with zipfile.ZipFile(out, "w") as archive:
        for name in sorted(entries):
            info = zipfile.ZipInfo(name, stamp)
            info.create_system, info.external_attr, info.compress_type = 3, 0o100644 << 16, zipfile.ZIP_DEFLATED
            archive.writestr(info, entries[name], compresslevel=9)
    return out.getvalue()


def archives(rows: DataFrame, epoch: int = 0, kind: str = "notes") -> DataFrame:
    """``path``, ``volume`` from 0, ``content`` of ZIPs per ``package`` over its (name, content) rows, a manifest of sizes and digests in each.

    A package of more entries or bytes than a volume's has several, over which its names are dealt
    by their hash; each is an archive of its own, made by one task, and its manifest tells which of how many it is.
    Of equal names the least content stays; a volume over the size budget, thus one huge entry, fails.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        volume, volumes = int(group["volume"].iloc[0]), int(group["volumes"].iloc[0])
        entries = dict(sorted(((n, bytes(c or b"")) for n, c in zip(group["name"], group["content"], strict=True)), reverse=True))
        if sum(map(len, entries.values())) > MAX_TOTAL:
            raise ValueError("package over the size budget")
        files = [{"path": n, "sha256": hashlib.sha256(entries[n]).hexdigest(), "size": len(entries[n])} for n in sorted(entries)]
        digest = hashlib.sha256(json.dumps(files, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(epoch))
        manifest = {"schema_version": 1, "package_type": kind, "generated_at": stamp, "source_date_epoch": epoch, "file_count": len(files), "archive_entry_count": len(files) + 1, "content_digest": digest, "files": files}
        if volumes > 1:
            manifest |= {"volume": volume, "volumes": volumes}
        entries[MANIFEST] = (json.dumps(manifest, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()
        return pd.DataFrame({"path": [f"{group['package'].iloc[0]}.zip"], "volume": [volume], "content": [_zip(entries, epoch)]})

    named = rows.select("package", "name", "content").where("name is not null")
    parts = F.greatest(F.ceil(F.count("*") / VOLUME_ENTRIES), F.ceil(F.coalesce(F.sum(F.length("content")), F.lit(0)) / VOLUME_BYTES))
    sized = named.groupBy("package").agg(parts.cast("int").alias("volumes")).withColumnRenamed("package", "of")
    dealt = named.join(sized, F.col("package").eqNullSafe(F.col("of"))).withColumn("volume", F.pmod(F.xxhash64("name"), F.col("volumes")).cast("int"))
    return dealt.select("package", "volume", "volumes", "name", "content").groupBy("package", "volume").applyInPandas(one, "path string, volume int, content binary")


def _slide(title: str, lines: list[str]) -> str:
    def box(number: int, name: str, y: int, height: int, size: int, texts: list[str]) -> str:
        paragraphs = "".join(f'<a:p><a:r><a:rPr lang="en-US" sz="{size}"/><a:t>{escape(t)}</a:t></a:r></a:p>' for t in texts) or "<a:p/>"
        return (
            f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="{name}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="457200" y="{y}"/><a:ext cx="11155680" cy="{height}"/></a:xfrm>'
            f'<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr wrap="square"/><a:lstStyle/>{paragraphs}</p:txBody></p:sp>'
        )

    group = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    return f'<p:sld xmlns:a="{_A}" xmlns:p="{_P}" xmlns:r="{_R}"><p:cSld><p:spTree>{group}{box(2, "Title", 365760, 914400, 2800, [title])}{box(3, "Body", 1463040, 4754880, 1800, lines)}</p:spTree></p:cSld></p:sld>'


def _deck(title: str, slides: list[tuple[str, list[str]]]) -> bytes:
    pages = [(title, []), *slides]
    numbers = range(1, len(pages) + 1)
    part = "application/vnd.openxmlformats-officedocument.presentationml."
    relation = "".join(f'<Relationship Id="rId{n}" Type="{_R}/slide" Target="slides/slide{n}.xml"/>' for n in numbers)
    overrides = "".join(f'<Override PartName="/ppt/slides/slide{n}.xml" ContentType="{part}slide+xml"/>' for n in numbers)
    entries = {
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/ppt/presentation.xml" ContentType="{part}presentation.main+xml"/>{overrides}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_TYPES}relationships"><Relationship Id="rId1" Type="{_R}/officeDocument" Target="ppt/presentation.xml"/></Relationships>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{_TYPES}relationships">{relation}</Relationships>',
        "ppt/presentation.xml": f'<p:presentation xmlns:a="{_A}" xmlns:p="{_P}" xmlns:r="{_R}"><p:sldIdLst>' + "".join(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>' for n in numbers) + '</p:sldIdLst><p:sldSz cx="12192000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
    }
    entries |= {f"ppt/slides/slide{n}.xml": _slide(*page) for n, page in zip(numbers, pages, strict=True)}
    return _zip({name: ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text).encode() for name, text in entries.items()}, 0)


def decks(slides: DataFrame) -> DataFrame:
    """``path``, ``content`` of a PPTX per deck: a title slide, then each slide's title with its proof object.

    ``slides``: deck, pos, title, role, proof, as ``operators.deck`` plans them; nulls are empty.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("pos").fillna("")
        pages = [(t, [f"Role: {r}", f"Proof object: {p}"]) for t, r, p in zip(ordered["title"], ordered["role"], ordered["proof"], strict=True)]
        name = str(group["deck"].iloc[0])
        return pd.DataFrame({"path": [f"{name}.pptx"], "content": [_deck(name, pages)]})

    return slides.select("deck", "pos", "title", "role", "proof").groupBy("deck").applyInPandas(one, "path string, content binary")


def _laid(item: dict, number: int) -> str:
    """One shape of a laid-out slide as XML: ``kind`` and ``x``, ``y``, and what its kind needs."""
    name = f'<p:cNvPr id="{number}" name="{item["kind"]} {number}"/>'
    off = f'<a:off x="{item["x"]}" y="{item["y"]}"/>'
    lines = lambda text: "".join(f"<a:p><a:r><a:t>{escape(line)}</a:t></a:r></a:p>" for line in text.split("\n"))
    if item["kind"] == "group":
        (w, h), (cx, cy), (cw, ch) = item["ext"], item["child_off"], item["child_ext"]
        frame = f'<a:xfrm{" flipH=" + chr(34) + "1" + chr(34) if item.get("flip") else ""}>{off}<a:ext cx="{w}" cy="{h}"/><a:chOff x="{cx}" y="{cy}"/><a:chExt cx="{cw}" cy="{ch}"/></a:xfrm>'
        inner = "".join(_laid(x, 100 * number + k) for k, x in enumerate(item["items"], 1))
        return f"<p:grpSp><p:nvGrpSpPr>{name}<p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr>{frame}</p:grpSpPr>{inner}</p:grpSp>"
    if item["kind"] == "table":
        rows = "".join('<a:tr h="1">' + "".join(f"<a:tc><a:txBody><a:bodyPr/>{lines(c)}</a:txBody></a:tc>" for c in row) + "</a:tr>" for row in item["rows"])
        return f'<p:graphicFrame><p:nvGraphicFramePr>{name}<p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><p:xfrm>{off}<a:ext cx="1" cy="1"/></p:xfrm><a:graphic><a:graphicData uri="{_A}/table"><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    if item["kind"] == "picture":
        return f'<p:pic><p:nvPicPr>{name}<p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill/><p:spPr><a:xfrm>{off}<a:ext cx="1" cy="1"/></a:xfrm></p:spPr></p:pic>'
    return f'<p:sp><p:nvSpPr>{name}<p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm>{off}<a:ext cx="1" cy="1"/></a:xfrm></p:spPr><p:txBody><a:bodyPr/>{lines(item["text"])}</p:txBody></p:sp>'


def laid_deck(slides: list[dict]) -> bytes:
    """A package of slides (``items`` and ``notes``, a text or None) with shapes, groups, tables and pictures where they are said to be."""
    head = f'xmlns:a="{_A}" xmlns:p="{_P}" xmlns:r="{_R}"'
    tree = lambda items: "<p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id=\"1\" name=\"\"/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>" + "".join(_laid(x, k) for k, x in enumerate(items, 2)) + "</p:spTree></p:cSld>"
    entries: dict[str, str] = {"ppt/presentation.xml": f"<p:presentation {head}/>"}
    for n, slide in enumerate(slides, 1):
        entries[f"ppt/slides/slide{n}.xml"] = f"<p:sld {head}>{tree(slide['items'])}</p:sld>"
        if slide.get("notes") is not None:
            entries[f"ppt/slides/_rels/slide{n}.xml.rels"] = f'<Relationships xmlns="{_TYPES}relationships"><Relationship Id="rId1" Type="{_R}/notesSlide" Target="../notesSlides/notesSlide{n}.xml"/></Relationships>'
            entries[f"ppt/notesSlides/notesSlide{n}.xml"] = f"<p:notes {head}>{tree([{'kind': 'text', 'x': 0, 'y': 0, 'text': slide['notes']}])}</p:notes>"
    return _zip({name: text.encode() for name, text in entries.items()}, 0)
