"""Single documents on the driver: changed fields, virtual fields, saving. Never part of a plan."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from typing import Any


class Document:
    def __init__(self, values: Mapping[str, Any] | None, model: Any = None, is_new: bool = True):
        self._model, self._values, self.is_new = model, copy.deepcopy(dict(values or {})), is_new
        self._before = copy.deepcopy(self._values)
        self._marked: set[str] = set()
        self._ignored: set[str] = set()
        self._errors: dict[str, str] = {}
        self._refs: dict[str, Any] = {}
        self.locals: dict[str, Any] = {}
        if is_new and self._schema:
            self._values = self._schema.defaults(self._values)
        for hook in self._schema.pres.get("init", []) if self._schema else ():
            hook(self)
        for method, args in (self._schema.options.get("queue", []) if self._schema else ()):
            getattr(self, method)(*args)

    @property
    def _schema(self) -> Any:
        return getattr(self._model, "schema", None)

    # Access.
    def get(self, path: str) -> Any:
        if self._schema and path in self._schema.virtuals and not (path in self._values and not self.modified_paths()):
            # Read with the row by its plan; of a new or changed document the getters run on its values.
            out = None
            for f in self._schema.virtuals[path].getters:
                out = f(self.get)
            return out
        value: Any = self._values
        for key in path.split("."):
            value = value.get(key) if isinstance(value, Mapping) else [x.get(key) for x in value] if isinstance(value, list) else None
        return value

    def set(self, path: str | Mapping[str, Any], value: Any = None) -> "Document":
        if isinstance(path, Mapping):
            for k, v in path.items():
                self.set(k, v)
            return self
        if self._schema and path in self._schema.virtuals and self._schema.virtuals[path].setters:
            for f in self._schema.virtuals[path].setters:
                f(value, self)
            return self
        *outer, last = path.split(".")
        at = self._values
        for key in outer:
            at = at.setdefault(key, {})
        at[last] = value
        return self

    def inc(self, path: str, by: float = 1) -> "Document":
        return self.set(path, (self.get(path) or 0) + by)

    def overwrite(self, values: Mapping[str, Any]) -> "Document":
        self._values = {**copy.deepcopy(dict(values)), **({"_id": self._values["_id"]} if "_id" in self._values else {})}
        return self

    def __getitem__(self, path: str) -> Any:
        return self.get(path)

    def __setitem__(self, path: str, value: Any) -> None:
        self.set(path, value)

    def __contains__(self, path: str) -> bool:
        return self.get(path) is not None

    def __getattr__(self, key: str) -> Any:
        if key.startswith("_") and key != "_id" and key != "__v":
            raise AttributeError(key)
        schema = self._schema
        if schema and key in schema.methods:
            return lambda *args, **kw: schema.methods[key](self, *args, **kw)
        if key in self._values or (schema and (key in schema.fields or key in schema.virtuals)):
            return self.get(key)
        raise AttributeError(key)

    @property
    def id(self) -> Any:
        return self._values.get("_id")

    # Changes.
    def modified_paths(self) -> list[str]:
        keys = dict.fromkeys([*self._values, *self._before])
        return [k for k in keys if k not in self._ignored and (k in self._marked or self._values.get(k) != self._before.get(k))]

    def direct_modified_paths(self) -> list[str]:
        return self.modified_paths()

    def is_modified(self, paths: str | list[str] | None = None) -> bool:
        changed = self.modified_paths()
        if paths is None:
            return bool(changed)
        wanted = paths.split() if isinstance(paths, str) else paths
        return any(p.split(".")[0] in changed for p in wanted)

    is_direct_modified = is_modified

    def mark_modified(self, path: str) -> None:
        self._marked.add(path)

    def unmark_modified(self, path: str) -> None:
        self._marked.discard(path)
        if path in self._values:
            self._before[path] = copy.deepcopy(self._values[path])

    def ignore(self, path: str) -> None:
        self._ignored.add(path)

    def get_changes(self) -> dict[str, Any]:
        return {p: self._values.get(p) for p in self.modified_paths()}

    def _settled(self) -> None:
        self._before, self._marked = copy.deepcopy(self._values), set()

    # References.
    def populate(self, path: str) -> "Document":
        field = self._schema.path(path)
        ref = field.options.get("ref") if field else None
        if ref is None:
            raise ValueError(f"{path} has no ref")
        other = self._model.database.collection(ref)
        held = self._values.get(path)
        self._refs[path] = held
        wanted = held if isinstance(held, list) else [held]
        found = {d.id: d for d in other.find({"_id": {"$in": [x for x in wanted if x is not None]}}).collect()} if any(x is not None for x in wanted) else {}
        self._values[path] = [found[x] for x in wanted if x in found] if isinstance(held, list) else found.get(held, held)
        self._before[path] = self._values[path]
        return self

    def populated(self, path: str) -> Any:
        """The reference behind a populated path, else None."""
        return self._refs.get(path)

    def depopulate(self, path: str | None = None) -> "Document":
        for p in [path] if path else list(self._refs):
            if p in self._refs:
                self._values[p] = self._before[p] = self._refs.pop(p)
        return self

    def assert_populated(self, path: str) -> "Document":
        if path not in self._refs:
            raise ValueError(f"{path} isn't populated")
        return self

    def get_populated_docs(self) -> list["Document"]:
        found = [self._values[p] for p in self._refs]
        return [d for x in found for d in (x if isinstance(x, list) else [x]) if isinstance(d, Document)]

    # Validation and saving.
    def validate(self, paths: list[str] | None = None) -> None:
        """Raises a ValidationError for broken rules and for what invalidate() has noted."""
        from papyra.schema import ValidationError

        if self._errors:
            raise ValidationError(", ".join(self._errors.values()))
        if self._schema:
            for hook in self._schema.pres.get("validate", []):
                hook(self)
            self._schema.check(self._schema.prepared(self._schema.frame(self._model.spark, [self._plain()])), paths)
            for hook in self._schema.posts.get("validate", []):
                hook(self)

    def validate_sync(self, paths: list[str] | None = None) -> Exception | None:
        try:
            self.validate(paths)
        except ValueError as e:
            return e
        return None

    def invalidate(self, path: str, message: str) -> None:
        self._errors[path] = message

    def mark_valid(self, path: str) -> None:
        self._errors.pop(path, None)

    def _plain(self) -> dict[str, Any]:
        """Values as they are stored: references instead of documents, no virtual fields."""
        virtual = self._schema.virtuals if self._schema else {}
        return {k: self._refs.get(k, v) for k, v in self._values.items() if k not in virtual}

    def save(self) -> "Document":
        if self._model is None:
            raise ValueError("this document has no collection")
        if self.is_new:
            made = self._model.create(self._plain())
            self._values = made._values
        elif changed := {p: self._plain().get(p) for p in self.modified_paths() if p != "_id"}:
            for hook in self._schema.pres.get("save", []) if self._schema else ():
                hook(self)
            changed = {p: self._plain().get(p) for p in self.modified_paths() if p != "_id"}
            self.validate(list(changed))
            self._model.update_one({"_id": self.id}, {"$set": changed})
            stored = self._model.find_by_id(self.id)
            populated = {k: self._values[k] for k in self._refs}
            self._values = {**stored._values, **populated}
            for hook in self._schema.posts.get("save", []) if self._schema else ():
                hook(self)
        self.is_new = False
        self._settled()
        return self

    def update_one(self, update: Mapping[str, Any]) -> Any:
        return self._model.update_one({"_id": self.id}, update)

    def replace_one(self, values: Mapping[str, Any]) -> Any:
        return self._model.replace_one({"_id": self.id}, values)

    def delete_one(self) -> int:
        return self._model.delete_one({"_id": self.id})

    remove = delete_one

    # Output.
    def to_object(self, virtuals: bool = False, minimize: bool = True, version_key: bool = True, transform: Any = None) -> dict[str, Any]:
        out = {k: v.to_object() if isinstance(v, Document) else [x.to_object() if isinstance(x, Document) else x for x in v] if isinstance(v, list) else copy.deepcopy(v) for k, v in self._values.items()}
        if virtuals and self._schema:
            out |= {p: self.get(p) for p in self._schema.virtuals}
        if minimize:
            out = {k: v for k, v in out.items() if v is not None and v != {}}
        if not version_key:
            out.pop("__v", None)
        return transform(self, out) if transform else out

    def to_json(self, **options: Any) -> dict[str, Any]:
        return self.to_object(**options)

    def equals(self, other: Any) -> bool:
        return isinstance(other, Document) and self.id is not None and self.id == other.id

    def __eq__(self, other: Any) -> bool:
        return self is other or self.equals(other)

    def __hash__(self) -> int:
        return hash(self.id)

    def clone(self) -> "Document":
        return Document(self._values, self._model, self.is_new)

    def is_empty(self, path: str | None = None) -> bool:
        value = self.get(path) if path else {k: v for k, v in self._values.items() if v is not None}
        return value is None or value == {}

    def is_default(self, path: str) -> bool:
        field = self._schema.path(path) if self._schema else None
        return field is not None and "default" in field.options and self.get(path) == field.get_default()

    def is_init(self, path: str) -> bool:
        return path in self._before

    def is_selected(self, path: str) -> bool:
        return path.split(".")[0] in self._values

    def get_all_subdocs(self) -> list[Mapping[str, Any]]:
        out: list = []
        stack = list(self._values.values())
        while stack:
            x = stack.pop()
            if isinstance(x, Mapping):
                out.append(x)
                stack += list(x.values())
            elif isinstance(x, list):
                stack += x
        return out

    def __repr__(self) -> str:
        return f"Document({self._values!r})"

