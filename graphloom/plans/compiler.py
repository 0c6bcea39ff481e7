"""Triple patterns compiled to constraints with their dependencies. Plans are tiny and live on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Term:
    kind: str
    text: str
    value: str = "entity"


@dataclass
class Constraint:
    cid: str
    head: Term
    relation: str
    tail: Term
    variants: tuple[str, ...]
    depends_on: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()
    terminal: bool = False


@dataclass
class Plan:
    constraints: list[Constraint] = field(default_factory=list)
    producers: dict[str, str] = field(default_factory=dict)
    answer: str | None = None
    reason: str | None = None

    @property
    def supported(self) -> bool:
        return self.reason is None


def parse_term(text: str, kind: str | None = None) -> Term:
    """``?x`` is a variable, ``lit:x`` the literal x, anything else an entity, unless a kind is given."""
    if kind == "LITERAL" or kind == "VARIABLE" and text.startswith("?lit"):
        return Term("variable", text, "literal") if text.startswith("?") else Term("literal", text)
    if kind == "VARIABLE" or text.startswith("?"):
        return Term("variable", text if text.startswith("?") else "?" + text)
    if text.startswith("lit:"):
        return Term("literal", text[4:])
    return Term("entity", text)


def compile_plan(patterns: list[dict]) -> Plan:
    """Grounds variables round by round: a pattern with one ungrounded end writes it, one without
    is a check. Two writers of a variable in one round make the plan ambiguous."""
    if not patterns:
        return Plan(reason="PLAN_EMPTY")
    terms = [(parse_term(p["head"], p.get("head_kind")), parse_term(p["tail"], p.get("tail_kind"))) for p in patterns]
    grounded: dict[str, int] = {}
    role: dict[int, tuple[str, ...]] = {}
    while len(role) < len(patterns):
        wanted: dict[str, list[int]] = {}
        settled: dict[int, tuple[str, ...]] = {}
        for n, ends in enumerate(terms):
            if n in role:
                continue
            open_ends = list(dict.fromkeys(t.text for t in ends if t.kind == "variable" and t.text not in grounded))
            loop = all(t.kind == "variable" for t in ends) and ends[0].text == ends[1].text
            if not open_ends:
                settled[n] = ()
            elif len(open_ends) == 1 and not loop:
                wanted.setdefault(open_ends[0], []).append(n)
        if any(len(w) > 1 for w in wanted.values()):
            return Plan(reason="PLAN_AMBIGUOUS_WRITER")
        settled |= {w[0]: (v,) for v, w in wanted.items()}
        if not settled:
            return Plan(reason="PLAN_CYCLE")
        role |= settled
        grounded |= {v: w[0] for v, w in wanted.items()}
    read: set[str] = set()
    plan = Plan(producers={v: f"c{n}" for v, n in grounded.items()})
    for n, (p, ends) in enumerate(zip(patterns, terms)):
        reads = [t.text for t in ends if t.kind == "variable" and t.text not in role[n]]
        read.update(reads)
        variants = tuple(p.get("relation_variants") or ())
        relation = p.get("relation") or (variants[0] if variants else "")
        if relation not in variants:
            variants = (relation, *variants)
        plan.constraints.append(Constraint(f"c{n}", ends[0], relation, ends[1], variants, tuple(dict.fromkeys(f"c{grounded[v]}" for v in reads)), role[n]))
    for c in plan.constraints:
        c.terminal = not any(v in read for v in c.writes)
    unread = [v for v in plan.producers if v not in read]
    plan.answer = unread[0] if len(unread) == 1 else None
    return plan


def topo_ranks(plan: Plan) -> dict[str, int]:
    """0 without dependencies, else one more than the highest of them."""
    ranks: dict[str, int] = {}
    while len(ranks) < len(plan.constraints):
        for c in plan.constraints:
            if c.cid not in ranks and all(d in ranks for d in c.depends_on):
                ranks[c.cid] = 1 + max((ranks[d] for d in c.depends_on), default=-1)
    return ranks


def dependencies(plan: Plan) -> set[tuple[str, str]]:
    """(read, written) for every variable that some constraint writes from another."""
    return {(t.text, w) for c in plan.constraints for t in (c.head, c.tail) if t.kind == "variable" and t.text not in c.writes for w in c.writes}
