"""Miners that search at random under a seed: LogSig (local search) and MoLFI (a genetic algorithm). Both keep all distinct lines."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import covers
from ..functions.tokens import ordered_pairs, tokenized
from .sequential import Result, run_miner


class LogSig:
    """Groups lines by their ordered word pairs: a line moves to the group where the potential gains most, until a pass moves
    none or ``max_pass`` passes are done (None: as many as it takes); each group's template is its most common line, rare words dropped.
    """

    def __init__(self, groups: int, seed: int, max_pass: int | None) -> None:
        self.groups, self.seed, self.max_pass = groups, seed, max_pass
        self.lines: list[tuple[int, list[str]]] = []

    def add(self, line_id: int, tokens: list[str]) -> None:
        self.lines.append((line_id, tokens))

    def _assign(self) -> list[int]:
        rng = random.Random(self.seed)
        pairs = [Counter((a, b) for i, a in enumerate(t) for b in t[i + 1 :]) for _, t in self.lines]
        group = [rng.randint(0, self.groups - 1) for _ in self.lines]
        size, seen = Counter(group), [Counter() for _ in range(self.groups)]
        for g, p in zip(group, pairs, strict=True):
            seen[g].update(p)
        for _ in count() if self.max_pass is None else range(self.max_pass):
            moved = False
            for i, p in enumerate(pairs):
                at = group[i]
                own = {pair: seen[at][pair] / size[at] for pair in p}
                best, gain = at, 0.0
                for g in range(self.groups):
                    n = size[g] + 1.0
                    delta = 3 * sum(((seen[g][pair] + 1) / n) ** 2 - own[pair] ** 2 for pair in p)
                    if delta > gain:
                        best, gain = g, delta
                if best != at:
                    moved = True
                    group[i] = best
                    size[at] -= 1
                    size[best] += 1
                    seen[at].subtract(p)
                    seen[best].update(p)
            if not moved:
                break
        return group

    def templates(self) -> list[Result]:
        members: dict[int, list[tuple[int, list[str]]]] = {}
        for g, line in zip(self._assign(), self.lines, strict=True):
            members.setdefault(g, []).append(line)
        out = []
        for _, lines in sorted(members.items()):
            words = Counter(w for _, t in lines for w in t)
            half = math.ceil(len(lines) / 2)
            shapes = Counter(tuple(w if words[w] >= half else None for w in t) for _, t in lines)
            out.append((list(max(shapes, key=shapes.__getitem__)), len(lines), lines[0][0]))
        return out


def logsig(lines: DataFrame, grp_num: int = 30, seed: int = 0, max_pass: int | None = None) -> DataFrame:
    """At most ``grp_num`` templates."""
    return run_miner(lines, lambda: LogSig(grp_num, seed, max_pass))


def term_pairs(lines: DataFrame) -> DataFrame:
    """t1, t2, n: how often each ordered pair of tokens occurs, inside lines."""
    pairs = tokenized(lines).select(F.explode(ordered_pairs("tokens")).alias("p"))
    return pairs.groupBy(F.col("p.t1").alias("t1"), F.col("p.t2").alias("t2")).agg(F.count("*").alias("n"))


def group_signatures(lines: DataFrame, group: Column) -> DataFrame:
    """grp, template: the most common line of each given group after rare words are dropped (ties: the first seen)."""
    rows = lines.select("line_id", group.alias("grp"), "line")
    tokens = rows.join(tokenized(lines), "line_id").select("line_id", "grp", "tokens")
    half = tokens.groupBy("grp").agg(F.ceil(F.count("*") / 2).alias("half"))
    words = tokens.select("grp", F.explode("tokens").alias("word")).groupBy("grp", "word").agg(F.count("*").alias("n"))
    common = words.join(half, "grp").where("n >= half").select("grp", "word", F.lit(True).alias("keep"))
    cells = tokens.select("line_id", "grp", F.posexplode("tokens").alias("pos", "word")).join(common, ["grp", "word"], "left")
    shaped = cells.groupBy("line_id", "grp").agg(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("keep"), F.col("word")).alias("word")))).alias("x"))
    shapes = shaped.groupBy("grp", F.transform("x", lambda e: e["word"]).alias("template")).agg(F.count("*").alias("n"), F.min("line_id").alias("first"))
    return shapes.groupBy("grp").agg(F.max_by("template", F.struct("n", -F.col("first"))).alias("template"))


class MoLfi:
    """A genetic algorithm over sets of templates, trading constants against matches; every set is repaired to match all lines.

    Deterministic under its seed. The final choice counts, as the tournaments do not, the fully literal templates.
    """

    def __init__(self, chromosomes: int, rounds: int, seed: int) -> None:
        self.n, self.rounds, self.rng = chromosomes, rounds, random.Random(seed)
        self.lines: dict[tuple, list[int]] = {}

    def add(self, line_id: int, tokens: list[str]) -> None:
        self.lines.setdefault(tuple(tokens), [0, line_id])[0] += 1

    def _wild(self, tokens: tuple) -> tuple:
        """One constant at random becomes a wildcard."""
        fixed = [i for i, t in enumerate(tokens) if t is not None]
        if not fixed:
            return tokens
        i = self.rng.choice(fixed)
        return (*tokens[:i], None, *tokens[i + 1 :])

    def _fill(self, template: tuple) -> tuple:
        """One wildcard at random gets the word of a random line that matches."""
        gaps, fits = [i for i, t in enumerate(template) if t is None], self._lines_of(template)
        if not gaps or not fits:
            return template
        i = self.rng.choice(gaps)
        return (*template[:i], self.rng.choice(fits)[i], *template[i + 1 :])

    def _lines_of(self, template: tuple) -> list[tuple]:
        return [t for t in self.lines if covers(template, t)]

    def _clean(self, templates: list[tuple]) -> list[tuple]:
        distinct = list(dict.fromkeys(templates))
        return [t for t in distinct if not any(o is not t and covers(o, t) for o in distinct)]

    def _repaired(self, templates: list[tuple]) -> list[tuple]:
        missed = [t for t in self.lines if not any(covers(x, t) for x in templates)]
        return self._clean([*templates, *(self._wild(t) for t in missed)])

    def _score(self, templates: list[tuple]) -> float:
        constant = sum(sum(t is not None for t in x) / max(1, len(x)) for x in templates) / len(templates)
        return (constant + sum(len(self._lines_of(x)) for x in templates) / len(templates)) / 2

    def templates(self) -> list[Result]:
        if not self.lines:
            return []
        pool = [self._clean([self._wild(t) for t in self.lines]) for _ in range(self.n)]
        for _ in range(self.rounds):
            scores, winners = [self._score(c) for c in pool], []
            for _ in range(self.n):
                a, b = self.rng.sample(range(len(pool)), 2) if len(pool) > 1 else (0, 0)
                winners.append(pool[a] if scores[a] > scores[b] else pool[b])
            crossed = list(winners)
            for i in range(self.n // 2):
                a, b = winners[i], winners[-1 - i]
                crossed[i], crossed[-1 - i] = a[: len(a) // 2] + b[len(b) // 2 :], b[: len(b) // 2] + a[len(a) // 2 :]
            mutated = [[self._fill(t) if self.rng.random() <= 0.5 else self._wild(t) for t in c] for c in crossed]
            pool = [self._repaired(c) for c in mutated]
        literal = [sum(t in self.lines for t in c) for c in pool]
        best = pool[max(range(len(pool)), key=lambda i: (literal[i], -i))]
        out = []
        for t in best:
            fits = self._lines_of(t)
            out.append((list(t), sum(self.lines[x][0] for x in fits), min(self.lines[x][1] for x in fits)))
        return out


def molfi(lines: DataFrame, chromosome_num: int = 5, iter_round: int = 10, seed: int = 0) -> DataFrame:
    """Distinct templates that match every line, none covered by another."""
    return run_miner(lines, lambda: MoLfi(chromosome_num, iter_round, seed))
