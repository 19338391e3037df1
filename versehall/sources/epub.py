"""E-books in their zip form: reading order, contents, title and cover, decoded in the task that reads the file."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

MOST_COVER = 20 << 20  # bytes


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _words(text: str | None) -> str:
    return " ".join((text or "").split())


class Epub:
    """One book: `title`, `author`, `language`, `cover` (bytes, media type) and `chapters`."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        container = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if _name(e) == "rootfile")
        self.package = ElementTree.fromstring(self.zip.read(opf))
        self.home = posixpath.dirname(opf)
        self.items = {e.get("id"): e for e in self.package.iter() if _name(e) == "item"}
        of = lambda name: next((_words(e.text) for e in self.package.iter() if _name(e) == name and _words(e.text)), None)
        self.title, self.author, self.language = of("title"), of("creator"), of("language")

    def _path(self, base: str, target: str) -> str:
        return posixpath.normpath(posixpath.join(base, unquote(target)))

    def _item(self, wanted: Callable[[ElementTree.Element], bool]) -> ElementTree.Element | None:
        return next((e for e in self.items.values() if wanted(e)), None)

    def contents(self) -> Iterator[tuple[str, str, str]]:
        """(file, fragment, label) in the order of the navigation page, else of the older NCX file."""
        nav = self._item(lambda e: "nav" in (e.get("properties") or "").split())
        ncx = self._item(lambda e: e.get("media-type") == "application/x-dtbncx+xml")
        for page, links in ((nav, self._anchors), (ncx, self._points)):
            if page is None:
                continue
            path = self._path(self.home, page.get("href", ""))
            found = [(target, label) for target, label in links(ElementTree.fromstring(self.zip.read(path))) if target and label]
            for target, label in found:
                file, _, fragment = target.partition("#")
                yield self._path(posixpath.dirname(path), file), unquote(fragment), label
            if found:
                return

    @staticmethod
    def _anchors(root: ElementTree.Element) -> Iterator[tuple[str, str]]:
        return ((e.get("href", ""), _words("".join(e.itertext()))) for e in root.iter() if _name(e) == "a")

    @staticmethod
    def _points(root: ElementTree.Element) -> Iterator[tuple[str, str]]:
        for point in (e for e in root.iter() if _name(e) == "navPoint"):
            parts = {_name(e): e for e in reversed(list(point))}  # the first of each kind, not those of inner points
            label = next((_words(e.text) for e in parts["navLabel"].iter() if _name(e) == "text"), "") if "navLabel" in parts else ""
            yield (parts["content"].get("src", "") if "content" in parts else ""), label

    @property
    def cover(self) -> tuple[bytes, str] | None:
        """The manifest's cover image, or the one that the metadata name."""
        named = next((e.get("content") for e in self.package.iter() if _name(e) == "meta" and e.get("name") == "cover"), None)
        item = self._item(lambda e: "cover-image" in (e.get("properties") or "").split())
        item = self.items.get(named) if item is None else item
        if item is None or not (item.get("media-type") or "").startswith("image/"):
            return None
        path = self._path(self.home, item.get("href", ""))
        if path not in self.zip.namelist() or self.zip.getinfo(path).file_size > MOST_COVER:
            return None
        return self.zip.read(path), item.get("media-type")

    def chapters(self, text_of: Callable[[bytes, set[str]], list[tuple[str, str]]]) -> list[tuple[str, str]]:
        """SRC7: (title, text) along the reading order. `text_of` gives a page's text cut before the
        elements of some ids, each part with the id it begins at. A page that the contents point into at
        two places or more is cut there; a part is titled by the contents, else by its first line."""
        listed: dict[str, dict[str, str]] = {}
        for file, fragment, label in self.contents():
            listed.setdefault(file, {}).setdefault(fragment, label)
        out = []
        for ref in (e for e in self.package.iter() if _name(e) == "itemref" and e.get("linear") != "no"):
            item = self.items.get(ref.get("idref"))
            if item is None or "nav" in (item.get("properties") or "").split():
                continue
            path = self._path(self.home, item.get("href", ""))
            labels = listed.get(path, {})
            page = self.zip.read(path)
            parts = text_of(page, set(labels) - {""})
            if len({i for i, _ in parts} & set(labels)) + ("" in labels and parts[0][0] != "") < 2:
                parts = text_of(page, set())
                labels = {"": next(iter(labels.values()), "")}
            out += [(labels.get(i) or text.split("\n")[0][:200], text) for i, text in parts if text]
        return out
