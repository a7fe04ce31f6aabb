"""Edit logs: the pure reducer, undo and redo, and its folds over tables and streams.

A document's present is a map of its elements; user commands push it onto the past and clear the future, processing
output (system commands) is replayed over every snapshot and is no undo step. A log is folded in sequence order.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_HISTORY = 200
#: Element id -> element; ids are unique across the pages of a document, and an element names its page.
Elements = dict[str, dict]


class Document(dict):
    """The elements of all pages by id, with the pages' own fields (status, size, ...) by page id."""

    def __init__(self, elements: Elements | None = None, pages: dict[str, dict] | None = None):
        super().__init__(elements or {})
        self.pages = {"p0": {"status": "ready"}} if pages is None else pages

    @staticmethod
    def of(doc: Elements) -> Document:
        return doc if isinstance(doc, Document) else Document(doc)

    def having(self, elements: Elements) -> Document:
        return Document({**self, **elements}, self.pages)


class UnknownTarget(ValueError):
    """A command names an element or page that isn't there."""


def element(source: str, **more) -> dict:
    return {
        "source": source, "text": source, "state": "original", "alignment": "left", "locked": False, "styles": {}, "style_from": None, "typography": None, "origin": "scan", "page": "p0",
        "x": 0.0, "y": 0.0, "box": {"cx": 0.0, "cy": 0.0},
    } | more


def _edited(e: dict, text: str) -> str:
    return "original" if text == e["source"] and not e["styles"] else "edited"


def _text(e: dict, cmd: dict) -> dict:
    return e | {"text": cmd["text"], "state": _edited(e, cmd["text"])}


def _source(e: dict, cmd: dict) -> dict:
    """What was recognised is corrected: styles that were measured on the wrong glyphs go."""
    new = e | {"source": cmd["text"], "typography": None, "text": cmd["text"] if e["state"] == "original" else e["text"]}
    return new | {"state": "deleted" if e["state"] == "deleted" else _edited(new, new["text"])}


def _styled(e: dict, cmd: dict) -> dict:
    merging = cmd["type"] == "applyStyle"
    styles = (e["styles"] if merging else {}) | (cmd.get("styles") or {})
    # a style that is set to nothing goes back to what was detected
    styles = {k: v for k, v in styles.items() if v is not None}
    given = cmd.get("source_id") if merging else None
    new = e | {"styles": styles, "style_from": given or (e["style_from"] if styles else None)}
    if e["state"] == "deleted":
        return new
    return new | {"state": "edited" if merging and e["origin"] == "added" else _edited(new, e["text"])}


def _moved(e: dict, cmd: dict) -> dict:
    """The box, the bounding box and the frame of a measured style move together."""
    if e["origin"] != "added":
        raise UnknownTarget("only added boxes move")
    shifted = lambda b: b | {"cx": b["cx"] + cmd["dx"], "cy": b["cy"] + cmd["dy"]}
    t = e["typography"]
    frame = {"typography": t | {"frame": shifted(t["frame"])}} if t and t.get("frame") else {}
    return e | {"x": e["x"] + cmd["dx"], "y": e["y"] + cmd["dy"], "box": shifted(e["box"])} | frame


def _measured(e: dict, cmd: dict) -> dict:
    t = cmd.get("typography")
    return e | {"typography": t, "alignment": t["alignment"] if t and not e["locked"] else e["alignment"]}


#: Commands that change one element.
ON_ELEMENT = {
    "setText": _text, "setSourceText": _source, "setStyleOverrides": _styled, "applyStyle": _styled, "moveElement": _moved, "setTypography": _measured,
    "deleteElement": lambda e, cmd: e | {"state": "deleted"}, "restoreElement": lambda e, cmd: e | {"state": _edited(e, e["text"])},
    "setAlignment": lambda e, cmd: e | {"alignment": cmd["alignment"], "locked": True},
}


def find_element(doc: Elements, element_id: str) -> tuple[str, dict]:
    """(page, element) of an id, whichever page it is on."""
    if element_id not in doc:
        raise UnknownTarget(f"no element {element_id}")
    return doc[element_id]["page"], doc[element_id]


def _page_of(doc: Document, cmd: dict) -> str:
    page = cmd.get("page_id") or "p0"
    if page not in doc.pages:
        raise UnknownTarget(f"no page {page}")
    return page


def apply_command(doc: Elements, cmd: dict) -> Document:
    """The document after a command. ``doc`` is never changed; an unknown target raises."""
    doc, kind = Document.of(doc), cmd["type"]
    if kind in ON_ELEMENT:
        _, e = find_element(doc, cmd.get("element_id"))
        return doc.having({cmd["element_id"]: ON_ELEMENT[kind](e, cmd)})
    if kind == "addElement":
        x, y = cmd.get("x", 0.0), cmd.get("y", 0.0)
        added = element(cmd.get("text", ""), state="edited", origin="added", page=_page_of(doc, cmd), x=x, y=y, box={"cx": x, "cy": y})
        return doc.having({cmd["element_id"]: added})
    if kind == "updatePage":
        page = _page_of(doc, cmd)
        patch = dict(cmd.get("patch") or {})
        elements = patch.pop("elements", None)
        kept = doc if elements is None else {k: e for k, e in doc.items() if e["page"] != page} | {k: element("", page=page) | e for k, e in elements.items()}
        return Document(dict(kept), doc.pages | {page: doc.pages[page] | patch})
    if kind == "readHandwriting":
        out = Document(dict(doc), doc.pages)
        for g in cmd["groups"]:
            ids = g["element_ids"]
            if ids and all(i in doc and doc[i]["state"] == "original" for i in ids) and g.get("accepted", True):
                out[ids[0]] = element(g["text"], origin="handwriting", page=doc[ids[0]]["page"])
                for i in ids[1:]:
                    out.pop(i, None)
        return out
    raise ValueError(f"no command {kind}")


def touched_element(cmd: dict) -> str | None:
    """The element whose look a command changes; none for processing output of a page."""
    return None if cmd["type"] in ("updatePage", "setTypography", "readHandwriting") else cmd.get("element_id")


class History:
    """Present, past and future of one document."""

    def __init__(self, present: Elements, past: list[Document] | None = None, future: list[Document] | None = None):
        self.present, self.past, self.future = Document.of(present), past or [], future or []
        self.failed, self.error = 0, None

    def execute(self, cmd: dict) -> None:
        after = apply_command(self.present, cmd)
        self.past = [*self.past, self.present][-MAX_HISTORY:]
        self.present, self.future = after, []

    def replace_present(self, cmd: dict) -> None:
        """Processing output: over all snapshots; one in which it fails stays as it is."""

        def tried(doc: Document) -> Document:
            try:
                return apply_command(doc, cmd)
            except (ValueError, KeyError, TypeError):
                return doc

        self.present, self.past, self.future = tried(self.present), [tried(d) for d in self.past], [tried(d) for d in self.future]

    def undo(self) -> None:
        if self.past:
            self.future.insert(0, self.present)
            self.present = self.past.pop()

    def redo(self) -> None:
        if self.future:
            self.past.append(self.present)
            self.present = self.future.pop(0)

    def feed(self, kind: str, payload: str | None) -> None:
        """One row of a log. Commands that fail or can't be read are counted, change nothing, and the last one's error is kept."""
        if kind == "undo":
            self.undo()
        elif kind == "redo":
            self.redo()
        else:
            try:
                cmd = json.loads(payload or "null")
                if not isinstance(cmd, dict) or "type" not in cmd:
                    raise ValueError("no command")
                self.replace_present(cmd) if kind == "system" else self.execute(cmd)
            except (ValueError, KeyError, TypeError) as e:
                self.failed, self.error = self.failed + 1, f"{type(e).__name__}: {e}"

    def saved(self) -> str:
        plain = lambda d: [dict(d), d.pages]
        return json.dumps({"present": plain(self.present), "past": [plain(d) for d in self.past], "future": [plain(d) for d in self.future], "failed": self.failed, "error": self.error})

    @staticmethod
    def loaded(text: str) -> History:
        s = json.loads(text)
        h = History(Document(*s["present"]), [Document(*d) for d in s["past"]], [Document(*d) for d in s["future"]])
        h.failed, h.error = s["failed"], s["error"]
        return h


FOLDED = "doc_id long, element_id string, source string, text string, state string, alignment string, styled boolean, x double, modified boolean, n_past long, n_future long, n_failed long, last_error string"


def _rows(doc_id: int, h: History) -> list[tuple]:
    changed = lambda e: e["state"] == "deleted" or e["text"] != e["source"] or bool(e["styles"])
    return [(doc_id, k, e["source"], e["text"], e["state"], e["alignment"], bool(e["styles"]), float(e["x"]), changed(e), len(h.past), len(h.future), h.failed, h.error) for k, e in sorted(h.present.items())]


def initial(n: int = 5) -> Document:
    return {f"p0-e{k}": element(f"source {k}") for k in range(n)}


def fold(log: DataFrame, elements: int = 5) -> DataFrame:
    """Final elements of each document: log (doc_id, seq, kind, payload JSON), folded in order of seq.

    One document is one task's work, as each step depends on the last; documents are independent.
    """

    def of(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h = History(initial(elements))
        for kind, payload in pdf.sort_values("seq")[["kind", "payload"]].itertuples(index=False):
            h.feed(kind, payload)
        return pd.DataFrame(_rows(key[0], h), columns=[c.split()[0] for c in FOLDED.split(", ")])

    return log.groupBy("doc_id").applyInPandas(of, FOLDED)


def fold_stream(log: DataFrame, elements: int = 5) -> DataFrame:
    """The same fold with keyed state over a stream: each micro-batch gives the documents that it changed.

    Rows of a micro-batch are put in order of seq; the log has to arrive in order between batches.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def of(key, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        h = History.loaded(state.get[0]) if state.exists else History(initial(elements))
        rows = [r for b in batches for r in b[["seq", "kind", "payload"]].itertuples(index=False)]
        for _, kind, payload in sorted(rows):
            h.feed(kind, payload)
        state.update((h.saved(),))
        yield pd.DataFrame(_rows(key[0], h), columns=[c.split()[0] for c in FOLDED.split(", ")])

    return log.groupBy("doc_id").applyInPandasWithState(of, FOLDED, "history string", "update", GroupStateTimeout.NoTimeout)


def from_events(events: DataFrame, elements: int = 5) -> DataFrame:
    """An edit log from user events: error undoes, signup redoes, the others are commands of all kinds by their id; two in eleven are processing output."""
    n = F.col("event_id")
    turn = n % 11
    steps = F.col("event_type").isin("error", "signup")
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").when(turn < 2, "system").otherwise("user")
    view = F.element_at(F.array(*[F.lit(c) for c in ("deleteElement", "restoreElement", "setAlignment", "moveElement")]), (n % 4 + 1).cast("int"))
    bought = F.element_at(F.array(*[F.lit(c) for c in ("setText", "applyStyle", "applyStyle", "setStyleOverrides")]), (n % 4 + 1).cast("int"))
    type_ = (
        F.when(turn == 0, "setSourceText").when(turn == 1, "setTypography").when(F.col("event_type") == "view", view).when(F.col("event_type") == "purchase", bought)
        .when(n % 5 == 0, "addElement").when(n % 13 == 12, "updatePage").when(n % 17 == 16, "noCommand").otherwise("setText")
    )
    added = F.col("type").isin("addElement", "moveElement") | (n % 7 == 6)
    target = F.when(added, F.concat(F.lit("p0-a"), n % 3)).otherwise(F.concat(F.lit("p0-e"), n % elements))
    text = F.when((F.col("type") == "setText") & (n % 3 == 0), F.concat(F.lit("source "), n % elements)).otherwise(F.concat(F.lit("text "), n % 3))
    style = F.when(F.col("type").isin("applyStyle", "setStyleOverrides"), F.when(n % 4 == 2, F.lit('{"weight":null}')).otherwise(F.lit('{"weight":700}')))
    named = lambda name, v: F.concat(F.lit(f',"{name}":'), v)
    payload = F.concat(
        F.lit('{"type":"'), "type", F.lit('"'), named("element_id", F.concat(F.lit('"'), target, F.lit('"'))), named("text", F.concat(F.lit('"'), text, F.lit('"'))), F.coalesce(named("styles", style), F.lit("")),
        F.lit(',"alignment":"right","typography":{"alignment":"center"},"dx":1,"dy":2,"page_id":"'), F.when((F.col("type") == "updatePage") & (n % 2 == 0), "p9").otherwise("p0"), F.lit('","patch":{"status":"ready"}}'),
    )
    rows = events.select(F.col("user_id").alias("doc_id"), F.struct("ts", "event_id").alias("order"), "event_id", kind.alias("kind"), F.when(~steps, type_).alias("type"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("order")).alias("seq"), "kind", payload.alias("payload"))


def last_texts(log_rows: DataFrame) -> DataFrame:
    """Last writer wins: (doc_id, element_id, text, n) of the last text of each element, by (ts, event_id)."""
    return log_rows.groupBy("doc_id", "element_id").agg(F.max_by("text", F.struct("ts", "event_id")).alias("text"), F.count("*").alias("n"))


def compare_and_set(updates: DataFrame, key: list[str], base: str, order: list[str]) -> DataFrame:
    """Updates that were made against the newest version before them: an update whose base is older is dropped."""
    newest = F.coalesce(F.max("version").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return updates.withColumn("seen", newest).where(F.col(base) >= F.col("seen")).drop("seen")


def capped_history(log: DataFrame, limit: int = MAX_HISTORY) -> DataFrame:
    """The last ``limit`` user commands of each document: what undo can reach."""
    back = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("seq")))
    return log.where("kind = 'user'").withColumn("back", back).where(F.col("back") <= limit)


def debounced(events: DataFrame, key: str, ts: str, order: str, pause: str) -> DataFrame:
    """The last row of each burst: rows of a key closer than ``pause`` to the next are dropped."""
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, order))
    return events.where(F.lit(True)).withColumn("after", after).where(F.col("after").isNull() | (F.col("after") > F.col(ts) + F.expr(f"INTERVAL {pause}"))).drop("after")


def single_flight(requests: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first request of each key; what has the same key while one is known is not asked again."""
    return requests.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("turn = 1").drop("turn")


PAGES = "doc_id long, seq long, key string, hit boolean, evicted string, raw long"


def lru_cache(log: DataFrame, budget: int) -> DataFrame:
    """Simulates a page store that packs the least recently used pages beyond a byte budget, never the one in use.

    log: (doc_id, seq, key, bytes); hit: the page was there unpacked; evicted: keys packed at this step; raw: bytes
    unpacked after it. The store may exceed the budget when only the page in use is left.
    """

    def of(key, pdf: pd.DataFrame) -> pd.DataFrame:
        raw: dict[str, int] = {}
        out = []
        for seq, page, size in pdf.sort_values("seq")[["seq", "key", "bytes"]].itertuples(index=False):
            hit, gone = page in raw, []
            raw[page] = raw.pop(page, size)
            if not hit:
                for other in list(raw):
                    if sum(raw.values()) <= budget:
                        break
                    if other != page:
                        gone.append(other)
                        del raw[other]
            out.append((key[0], seq, page, hit, ",".join(gone), sum(raw.values())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])

    return log.groupBy("doc_id").applyInPandas(of, PAGES)


def export_rollup(pages: DataFrame, key: str, status: str) -> DataFrame:
    """(key, can_export, n_ready, skipped): a document can be exported when all pages are done and one is ready."""
    s = F.col(status)
    return pages.groupBy(key).agg((F.bool_and(s.isin("ready", "failed")) & F.bool_or(s == "ready")).alias("can_export"), F.count_if(s == "ready").alias("n_ready"), F.count_if(s != "ready").alias("skipped"))


def modified(state: Column, text: Column, source: Column, has_styles: Column) -> Column:
    return (state == "deleted") | (text != source) | has_styles
