"""Queries for modes by sifting and for support vector regression on them."""

from __future__ import annotations

from almanac.catalog.components import CK, KEYS
from almanac.catalog.registry import query
from almanac.functions.expr import shown
from almanac.operators import components as cops
from almanac.operators import sifting
from almanac.operators import supportvector as sv
from almanac.plans.lineage import cut
from almanac.sources import tables as src


def modes(spark, sf):
    return cut(sifting.sifted_components(src.filled(spark, sf), n=4, sifts=6, noise=0.2, pairs=2))


@query("decompose_sifted")
def _(spark, sf):
    return shown(modes(spark, sf), [*CK, "date"], ["value", "series_value"])


@query("sifted_quality")
def _(spark, sf):
    """Mean absolute correlation over the pairs of modes of each station."""
    return shown(cops.orthogonality(modes(spark, sf)), KEYS, ["orthogonality"])


@query("support_vector_fit")
def _(spark, sf):
    fit = sv.support_vector_fit(cut(cops.decompose(src.filled(spark, sf))))
    return shown(fit, [*CK, "n_train", "support", "tried"], ["cost", "gamma", "epsilon", "objective", "train_mse", "test_mse"])


@query("support_vector_grid")
def _(spark, sf):
    comp = cut(cops.decompose(src.filled(spark, sf)))
    tried = sv.support_vector_grid(comp, cops.component_properties(comp), sv.grid((0.1, 1.0, 10.0), (0.5, 2.0), (0.05, 0.2)))
    return shown(tried, [*CK, "n_train", "support"], ["cost", "gamma", "epsilon", "objective", "train_mse", "test_mse"])
