"""Pipelines of filters in stages: pre, prior, post; filters that ask to be deferred move to post."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from obsq.operators import filters, hops
from obsq.operators.space import ObsSpace

STAGES = {"obs pre filters": "pre", "obs prior filters": "prior", "obs filters": "prior", "obs post filters": "post"}


@dataclass
class Pipeline:
    pre: list[Mapping] = field(default_factory=list)
    prior: list[Mapping] = field(default_factory=list)
    post: list[Mapping] = field(default_factory=list)

    @classmethod
    def of(cls, observer: Mapping) -> "Pipeline":
        """From the lists of an observer, each filter's keys checked."""
        out = cls()
        for key, stage in STAGES.items():
            for spec in observer.get(key) or ():
                if spec.get("filter") not in filters.FILTERS and spec.get("filter") not in filters.WHOLE:
                    raise KeyError(f"unknown filter {spec.get('filter')!r}")
                (out.post if spec.get("defer to post") else getattr(out, stage)).append(spec)
        return out

    def ordered(self, iteration: int = 0) -> list[Mapping]:
        """The filters that are due, in the order in which they run."""
        return [s for s in (*self.pre, *self.prior, *self.post) if filters.due(s, iteration)]

    def run(self, space: ObsSpace, iteration: int = 0) -> ObsSpace:
        for spec in self.ordered(iteration):
            space = filters.apply(space, spec, iteration)
        return space


APPLICATIONS: dict = {}


def application(name: str):
    """Register what runs under a name."""

    def put(f):
        APPLICATIONS[name] = f
        return f

    return put


def dispatch(name: str, *args, **kwargs):
    """Run an application by name, whatever its case."""
    key = name.lower()
    if key not in APPLICATIONS:
        raise ValueError(f"unknown application {name!r}; there are {sorted(APPLICATIONS)}")
    return APPLICATIONS[key](*args, **kwargs)


@application("hofx4d")
def hofx(space: ObsSpace, observer: Mapping, iteration: int = 0, departures: str = "ombg") -> ObsSpace:
    """What the observer's operator simulates, if it names one, then quality control and departures: `ombg`, `oman` or another group."""
    if operator := observer.get("obs operator"):
        space = space.with_columns({f"HofX/{v}": c for v, c in hops.operator_of(operator, space.variables).items()})
    done = Pipeline.of(observer).run(space, iteration)
    return done.with_columns({f"{departures}/{v}": done.departure(v) for v in done.variables})


@application("convertstate")
def convert(state, fields: Mapping[str, str]):
    """A state's fields under other names; those not named are left out."""
    return state.where(state["field"].isin(list(fields))).replace(dict(fields), subset=["field"])
