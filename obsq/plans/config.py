"""Configuration text: templates, tokens, includes, and YAML in which a key that is there twice is an error."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from datetime import datetime
from pathlib import Path

from obsq.functions import scalars

TEMPLATE_FILTERS: dict[str, Callable] = {"to_YMDH": scalars.to_ymdh, "to_isotime": scalars.to_isotime, "to_fv3time": scalars.to_model_time, "upper": str.upper, "lower": str.lower}


def render(text: str, values: Mapping[str, object], folder: str | Path | None = None, depth: int = 0) -> str:
    """`!INC path` lines, `{{ x | filter }}`, `$(X)`, `${X}` and `@X@`, in this order; an unknown name is an error."""
    if depth > 20:
        raise ValueError("includes go too deep")

    def include(m: re.Match) -> str:
        path = Path(folder or ".") / substitute(m[2].strip(), values)
        inner = render(path.read_text(), values, path.parent, depth + 1)
        return "\n".join(m[1] + line for line in inner.splitlines())

    return substitute(re.sub(r"^([ \t]*)!INC[ \t]+(.+)$", include, text, flags=re.M), values)


def substitute(text: str, values: Mapping[str, object]) -> str:
    def get(name: str):
        if name not in values:
            raise KeyError(f"no value for {name!r}")
        return values[name]

    def template(m: re.Match) -> str:
        name, *names = (p.strip() for p in m[1].split("|"))
        x = get(name)
        for f in names:
            if f not in TEMPLATE_FILTERS:
                raise KeyError(f"unknown template filter {f!r}")
            x = TEMPLATE_FILTERS[f](x)
        return str(x)

    text = re.sub(r"\{\{(.+?)\}\}", template, text)
    text = re.sub(r"\$\((\w+)\)|\$\{(\w+)\}", lambda m: str(get(m[1] or m[2])), text)
    return re.sub(r"@([A-Z][A-Z0-9_]*)@", lambda m: str(get(m[1])), text)


def cast_env(env: Mapping[str, str]) -> dict[str, object]:
    """Environment strings as dates, booleans, numbers or text."""
    out: dict[str, object] = {}
    for k, v in env.items():
        if re.fullmatch(r"\d{10}", v):
            out[k] = datetime.strptime(v, "%Y%m%d%H")
        elif v.lower() in ("true", "yes", ".true.", "false", "no", ".false."):
            out[k] = v.lower() in ("true", "yes", ".true.")
        elif re.fullmatch(r"-?\d+", v) and not re.fullmatch(r"0\d+", v):
            out[k] = int(v)
        elif re.fullmatch(r"-?\d*\.\d+(e-?\d+)?", v, re.I):
            out[k] = float(v)
        else:
            out[k] = v
    return out


def load(text: str, merge_duplicates: bool = False):
    """YAML, with anchors and merge keys. A key twice in a mapping is an error, or, if asked for, its lists are joined."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        loader.flatten_mapping(node)  # what is merged in comes first, and gives way to the mapping's own keys
        out: dict = {}
        own: set = set()
        for k, v in node.value:
            key, value = loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)
            if node.start_mark.index <= k.start_mark.index < node.end_mark.index:
                if key in own:
                    if not merge_duplicates:
                        raise ValueError(f"line {k.start_mark.line + 1}: key {key!r} is there twice")
                    if isinstance(value, list) and isinstance(out[key], list):
                        value = out[key] + value
                own.add(key)
            out[key] = value
        return out

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml.load(text, Loader)


def concatenate(fragments: list[str], base: str, token: str = "@OBSERVATIONS@") -> str:
    """Fragments put in the base's place for them, indented as it is, as text: anchors reach over them."""
    m = re.search(rf"^([ \t]*){re.escape(token)}[ \t]*$", base, re.M)
    if not m:
        raise ValueError(f"the base has no line {token}")
    body = "\n".join(m[1] + line if line.strip() else line for f in fragments for line in f.splitlines())
    return base[: m.start()] + body + base[m.end() :]


def observers(tree: Mapping) -> list:
    """The list of observation spaces, in any of the three layouts."""
    for path in (("cost function", "observations", "observers"), ("observations", "observers"), ("observers",), ("observations",)):
        at: object = tree
        for k in path:
            at = at.get(k) if isinstance(at, Mapping) else None
        if isinstance(at, list):
            return at
    raise KeyError("no observation spaces")
