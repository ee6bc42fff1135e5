"""The slow loop: edit scripts over a codebook, validated as a whole, gated by a person, applied in order.

A codebook is small beside its corpus and lives on the driver here as {code_id: code}; a code is a dict of id, name,
description, parent_id and evidence [(response_id, quote)].
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from copy import deepcopy
from hashlib import sha256

Book = dict[str, dict]


class OperationError(ValueError):
    pass


class EvidenceLoss(OperationError):
    pass


def code_id(name: str) -> str:
    return "code-" + sha256(name.encode()).hexdigest()[:16]


def new_code(name: str, description: str = "", parent_id: str | None = None, evidence=()) -> dict:
    return {"id": code_id(name), "name": name, "description": description, "parent_id": parent_id, "evidence": [tuple(e) for e in evidence]}


def evidence_of(book: Book) -> Counter:
    return Counter(e for c in book.values() for e in c["evidence"])


def _get(book: Book, target: str) -> dict:
    hit = book.get(target) or next((c for c in book.values() if c["name"] == target), None)
    if hit is None:
        raise OperationError(f"there is no code {target}")
    return hit


def _children(book: Book, code: dict) -> list[dict]:
    return [c for c in book.values() if c["parent_id"] == code["id"]]


def _unite(*groups) -> list[tuple]:
    return sorted({tuple(e) for g in groups for e in g})


def _create(book: Book, op: dict) -> None:
    p = op["payload"]
    code = new_code(p["name"], p.get("description", ""), p.get("parent_id"))
    if code["id"] in book:
        raise OperationError(f"{p['name']} exists")
    if code["parent_id"] and code["parent_id"] not in book:
        raise OperationError("the parent does not exist")
    book[code["id"]] = code


def _merge(book: Book, op: dict) -> None:
    if len(op["targets"]) < 2:
        raise OperationError("a merge needs two codes")
    codes = [_get(book, t) for t in op["targets"]]
    into = op["payload"].get("into") or codes[0]["name"]
    target = next((c for c in book.values() if c["name"] == into), None) or new_code(into, codes[0]["description"], codes[0]["parent_id"])
    target["evidence"] = _unite(target["evidence"], *(c["evidence"] for c in codes))
    target["description"] = op["payload"].get("description") or target["description"]
    gone = {c["id"] for c in codes} - {target["id"]}
    for c in book.values():
        if c["parent_id"] in gone:
            c["parent_id"] = target["id"]
    for g in gone:
        del book[g]
    if target["parent_id"] in gone or target["parent_id"] == target["id"]:
        target["parent_id"] = None
    book[target["id"]] = target


def _split(book: Book, op: dict) -> None:
    code, parts = _get(book, op["targets"][0]), op["payload"].get("into", [])
    if len(parts) < 2:
        raise OperationError("a split needs two parts")
    if len({p["name"].casefold() for p in parts}) < len(parts):
        raise OperationError("two parts of a split have one name")
    # a part may stand under a parent of its own
    parents = [_get(book, p["parent_id"])["id"] if p.get("parent_id") else code["parent_id"] for p in parts]
    made = [new_code(p["name"], p.get("description", ""), up) for p, up in zip(parts, parents)]
    claims = [({q for q in p.get("quotes", [])}, set(p.get("response_ids", []))) for p in parts]
    for e in code["evidence"]:  # the first claim holds, what nobody claims goes to the first part
        k = next((k for k, (quotes, ids) in enumerate(claims) if e[1] in quotes or e[0] in ids), 0)
        made[k]["evidence"].append(e)
    for c in _children(book, code):
        c["parent_id"] = made[0]["id"]
    del book[code["id"]]
    for m in made:
        if m["id"] in book:
            raise OperationError(f"{m['name']} exists")
        book[m["id"]] = m


def _reparent(book: Book, op: dict) -> None:
    parent = op["payload"].get("parent")
    up = _get(book, parent)["id"] if parent else None
    for t in op["targets"]:
        code = _get(book, t)
        at = up
        while at:
            if at == code["id"]:
                raise OperationError("a code cannot stand under itself")
            at = book[at]["parent_id"] if at in book else None
        code["parent_id"] = up


def _rename(book: Book, op: dict) -> None:
    code, name = _get(book, op["targets"][0]), op["payload"]["name"]
    old, pairs = code["name"], []
    for c in list(book.values()):
        if c is code:
            pairs.append((c, name))
        elif "-" not in old and c["name"].startswith(old + "-"):  # a family's name is part of its members' names
            pairs.append((c, name + c["name"][len(old) :]))
    moved = {c["id"]: code_id(n) for c, n in pairs}
    for c, n in pairs:
        del book[c["id"]]
    for c, n in pairs:
        c["id"], c["name"] = moved[c["id"]], n
        if c["id"] in book:
            raise OperationError(f"{n} exists")
        book[c["id"]] = c
    for c in book.values():
        c["parent_id"] = moved.get(c["parent_id"], c["parent_id"])


APPLY: dict[str, Callable[[Book, dict], None]] = {"create": _create, "merge": _merge, "split": _split, "reparent": _reparent, "rename": _rename}


def apply_operations(book: Book, operations: list[dict]) -> tuple[Book, list[dict]]:
    """A new codebook after the operations in order, and per operation what names came and went. Evidence must be conserved as
    a set by every operation."""
    now, effects = deepcopy(book), []
    for k, op in enumerate(operations):
        before, names = set(evidence_of(now)), {c["name"] for c in now.values()}
        if op.get("type") not in APPLY:
            raise OperationError(f"operation {k}: unknown type {op.get('type')}")
        APPLY[op["type"]](now, op)
        after = {c["name"] for c in now.values()}
        if before != set(evidence_of(now)):
            raise EvidenceLoss(f"operation {k} does not conserve evidence")
        effects.append({"index": k, "type": op["type"], "added": sorted(after - names), "removed": sorted(names - after)})
    return now, effects


def validate_script(operations: list[dict], book: Book, depth: int = 2) -> list[str]:
    """What is wrong with a script: an operation that cannot be applied, or a codebook that breaks the shape rules after it."""
    try:
        after, _ = apply_operations(book, operations)
    except (OperationError, KeyError, IndexError) as e:
        return [f"{type(e).__name__}: {e}"]
    wrong = []
    names = Counter(c["name"].casefold() for c in after.values())
    wrong += [f"duplicate name {n}" for n, k in names.items() if k > 1]
    for c in after.values():
        level, at, seen = 1, c["parent_id"], {c["id"]}
        while at and at in after and at not in seen:
            seen.add(at)
            level, at = level + 1, after[at]["parent_id"]
        if at and at not in after:
            wrong.append(f"{c['name']}: the parent does not exist")
        elif at:
            wrong.append(f"{c['name']}: the parents form a circle")
        elif level > depth:
            wrong.append(f"{c['name']}: too deep")
    return wrong


def reject_all(diff: list[dict]) -> list[bool]:
    """The gate when nobody decides."""
    return [False] * len(diff)


def scripted(decisions: list[bool]) -> Callable[[list[dict]], list[bool]]:
    def gate(diff: list[dict]) -> list[bool]:
        if len(diff) != len(decisions):
            raise ValueError("there are other operations than decisions")
        return list(decisions)

    return gate


def console(ask: Callable[[str], str] = input) -> Callable[[list[dict]], list[bool]]:
    return lambda diff: [ask(f"{d['type']} {d['removed']} -> {d['added']}? [y/N] ").strip().lower() == "y" for d in diff]


def build_diff(operations: list[dict], book: Book) -> list[dict]:
    return apply_operations(book, operations)[1]


def run_checkpoint(book: Book, operations: list[dict], gate: Callable[[list[dict]], list[bool]] = reject_all) -> dict:
    """Validate, show, decide, apply what was accepted, and validate that again; an invalid script changes nothing."""
    wrong = validate_script(operations, book)
    if wrong:
        return {"book": book, "status": "invalid", "problems": wrong, "accepted": [], "effects": []}
    decided = gate(build_diff(operations, book))
    accepted = [o for o, yes in zip(operations, decided) if yes]
    wrong = validate_script(accepted, book)
    if wrong:
        return {"book": book, "status": "invalid", "problems": wrong, "accepted": [], "effects": []}
    after, effects = apply_operations(book, accepted)
    return {"book": after, "status": "applied" if accepted else "rejected", "problems": [], "accepted": accepted, "effects": effects}
