import gzip
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions import codecs, entropy, hydro, inference, physics, recon
from gridloom.plans.registry import QUERIES


@pytest.fixture
def rough():
    rng = np.random.default_rng(3)
    return np.cumsum(np.cumsum(rng.normal(0, 0.3, (33, 33)), 0), 1) * 0.1


def test_pit_fills_to_its_spill():
    z = np.full((5, 5), 10.0)
    z[2, 2], z[0, 2] = 1.0, 4.0
    f = hydro.filled(z)
    assert f[2, 2] == pytest.approx(10.0, abs=1e-4) and f[2, 2] > 9.99


def test_fill_is_minimax_path(rough):
    """Without the lift, a filled height is the lowest pass on any way to the edge."""
    f = hydro.filled(rough, lift=0.0)
    best = np.full(rough.shape, np.inf)
    best[[0, -1], :], best[:, [0, -1]] = rough[[0, -1], :], rough[:, [0, -1]]
    for _ in range(rough.size):
        p = np.pad(best, 1, constant_values=np.inf)
        near = np.minimum.reduce([p[1 + a : 34 + a, 1 + b : 34 + b] for a, b in hydro.NEIGHBOURS])
        new = np.minimum(best, np.maximum(near, rough))
        if np.array_equal(new, best):
            break
        best = new
    assert np.array_equal(f, best)


def test_every_cell_drains_once(rough):
    r = hydro.route(rough)
    assert r["upstream"][r["receiver"] < 0].sum() == rough.size
    assert (r["receiver"][1:-1, 1:-1] >= 0).all()
    low = r["fill"].ravel()[np.maximum(r["receiver"].ravel(), 0)]
    assert (low < r["fill"].ravel())[r["receiver"].ravel() >= 0].all()
    assert hydro.jaccard(r["upstream"] > 8, r["upstream"] > 8) == 1 and hydro.jaccard(*[np.zeros(3, bool)] * 2) is None


def test_plane_drains_down():
    z = np.arange(25.0).reshape(5, 5)
    to = hydro.receivers(z)
    assert to[2, 2] == 6 or to[2, 2] == 7
    assert to[0, 0] == -1


def test_lowest_edge_policy_has_one_outlet(rough):
    r = hydro.route(rough, policy="lowest-edge")
    assert len(np.unique(r["outlet"])) == 1


@pytest.mark.parametrize("name", [n for n, c in codecs.CODECS.items() if not c.absent])
def test_codecs_keep_their_bound(name, rough):
    c = codecs.CODECS[name]
    for bound in (0.01, 0.1):
        back = c.decode(c.encode(rough, bound), rough.shape, bound)
        assert np.abs(back - rough).max() <= (bound * (1 + 1e-9) if c.bounded else 1e-5)


def test_pages_refuse_damage(rough):
    good = codecs.page_bytes(rough, 2, 0.01, 5.0)
    assert np.abs(codecs.page_values(good) - rough).max() <= 0.005 + 1e-9
    raw = gzip.decompress(good)
    bad = [good[:-3], good + b"x", b"", b"no gzip", gzip.compress(raw[:20]), gzip.compress(b"XXXX" + raw[4:]), gzip.compress(raw[:-4]), gzip.compress(raw + b"1234")]
    for blob in bad:
        with pytest.raises(ValueError):
            codecs.page_values(blob)
    for z in (np.full((4, 4), np.nan), np.zeros((3, 4)), np.full((4, 4), 1e12)):
        with pytest.raises(ValueError):
            codecs.page_bytes(z)


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=60))
def test_varints_come_back(values):
    raw = codecs.varints(np.array(values, dtype=np.uint64))
    assert len(raw) == sum(max(1, -(-v.bit_length() // 7)) for v in values)
    back, used = codecs.unvarints(raw, len(values))
    assert back.tolist() == values and used == len(raw)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.integers(-(2**20), 2**20), st.integers(0, entropy.TABLES - 1)), max_size=80))
def test_entropy_coding_comes_back(pairs):
    k, t = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
    blob = entropy.encode(k, t)
    d = entropy.Decoder(blob)
    assert d.take(t).tolist() == k.tolist() and d.finished()
    if len(k):
        assert 8 * len(blob) <= entropy.ideal_bits(k, t) + 8 * 14 + 0.02 * len(k)


def test_tables_are_whole():
    assert (entropy.FREQ.sum(1) == 1 << entropy.PROB_BITS).all() and (entropy.FREQ >= 1).all()


@pytest.mark.parametrize("bound", [0.001, 0.02, 0.3])
def test_multilevel_holds_its_bound(rough, bound):
    codes, tables, rec = entropy.multilevel(rough, bound)
    blob = entropy.encode(codes, tables)
    back = entropy.rebuild(blob, 33, bound)
    assert np.array_equal(back, rec) and np.abs(back - rough).max() <= bound + 1e-12
    with pytest.raises(ValueError):
        entropy.rebuild(blob[:-4], 33, bound)
    with pytest.raises(ValueError):
        entropy.multilevel(rough[:20, :20], bound)


def test_corrections_come_back():
    rng = np.random.default_rng(1)
    cells, codes = rng.choice(1000, 80, replace=False), rng.integers(-900, 900, 80)
    blob = codecs.Corrections.of(cells, codes, 0.01).to_bytes()
    back = codecs.Corrections.from_bytes(blob)
    order = np.argsort(cells)
    assert back.cells.tolist() == cells[order].tolist() and back.codes.tolist() == codes[order].tolist() and back.quantum == 0.01
    for bad in (b"XXXX", b"XXXX" + blob[4:], blob[:-2], blob + b"x" if blob[16] == 0 else blob[:-1], blob[:16] + b"\x07" + blob[17:]):
        with pytest.raises(ValueError):
            codecs.Corrections.from_bytes(bad)
    assert len(codecs.Corrections.from_bytes(codecs.Corrections.of(np.array([], int), np.array([], int), 1.0).to_bytes()).cells) == 0
    assert codecs.Corrections.of(np.array([3]), np.array([-2]), 0.5).applied(np.zeros((2, 2))).tolist() == [[0, 0], [0, -1]]


def test_kriging_is_exact_and_keeps_planes():
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 20, (40, 2))
    z = 3 + 0.5 * xy[:, 0] - 0.2 * xy[:, 1]
    at = rng.uniform(0, 20, (10, 2))
    est, var = recon.krige(xy, z, at, 1.0, 5.0)
    assert np.allclose(est, 3 + 0.5 * at[:, 0] - 0.2 * at[:, 1], atol=1e-6) and (var >= 0).all()
    assert np.allclose(recon.krige(xy, z, xy, 1.0, 5.0)[0], z, atol=1e-6)


def test_holes_under_a_plane():
    z = np.add.outer(np.arange(12.0), 2 * np.arange(12.0))
    holed = z.copy()
    holed[4:7, 4:7] = np.nan
    for order in (1, 2):
        assert np.allclose(recon.fill_holes(holed, order), z)
    assert np.array_equal(recon.fill_holes(z), z)


def test_thin_plate_follows_samples():
    z = np.add.outer(np.sin(np.arange(16) / 5), np.cos(np.arange(16) / 5))
    at = np.arange(0, 256, 2)
    assert np.abs(recon.thin_plate(z.shape, at, z.ravel()[at], 1e-4) - z).max() < 0.1


def test_blocks_keep_apart():
    z = np.random.default_rng(5).normal(size=(120, 120)) * np.linspace(1, 9, 120)
    got = recon.choose_blocks(z, 8, 16, 12, [1, 8], 24)
    assert len(got) == 12 and got == recon.choose_blocks(z, 8, 16, 12, [1, 8], 24) != recon.choose_blocks(z, 8, 16, 12, [2, 8], 24)
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) >= 16 for i, a in enumerate(got) for b in got[:i])
    assert all(sum(b[2] == s for b in got) >= 4 for s in range(3)) and all(8 <= v <= 120 - 8 - 8 - 1 and v % 8 == 0 for b in got for v in b[:2])
    for r, c, _, relief in got:
        part = z[max(0, r - 8) : r + 16, max(0, c - 8) : c + 16]
        assert relief == part.max() - part.min()
    few = recon.choose_blocks(z, 8, 60, 12, [1, 8], 24)  # keeping so far apart leaves four at most
    assert 1 <= len(few) <= 4


def test_phase_kernels_learn_bilinear():
    rng = np.random.default_rng(2)
    rough = rng.normal(size=(20, 20)).cumsum(0)
    mid = lambda x: np.insert(x, slice(1, None), (x[:-1] + x[1:]) / 2, axis=0)
    fine = mid(mid(rough).T).T
    sums = recon.phase_sums(rough, fine, 2)
    w = recon.phase_kernels(sums)
    assert w.shape == (2, 2, 9) and np.allclose(w.sum(-1), 1)
    assert np.allclose(w[0, 0], np.eye(9)[4], atol=1e-4) and np.allclose(w[0, 1], (np.eye(9)[4] + np.eye(9)[5]) / 2, atol=1e-4)
    assert np.allclose(recon.brought_up(rough, w), fine, atol=1e-3)
    x = np.lib.stride_tricks.sliding_window_view(np.pad(rough, 1, mode="reflect"), (3, 3))[:19, :19].reshape(-1, 9)
    t = fine[1::2, 1::2].ravel() - x.mean(1)
    assert np.allclose(sums[1, 1], (x - x.mean(1)[:, None]).T @ np.column_stack([x - x.mean(1)[:, None], t]))


@pytest.mark.parametrize("boundary", ["closed", "periodic"])
@pytest.mark.parametrize("critical", [None, 1.2])
def test_diffusion_conserves(rough, boundary, critical):
    u = rough.copy()
    for _ in range(20):
        u = u + physics.stable_step(1.0, 1.0, critical) * physics.diffusion(u, 1.0, 1.0, critical, boundary)
    assert u.sum() == pytest.approx(rough.sum(), abs=1e-8) and u.var() < rough.var()


def test_sine_decays():
    n = 64
    z = np.tile(np.sin(2 * np.pi * np.arange(n) / n), (n, 1))
    k = 2 - 2 * math.cos(2 * math.pi / n)
    u = z + 0.1 * physics.diffusion(z, 1.0, 1.0, boundary="periodic")
    assert np.allclose(u, (1 - 0.1 * k) * z)


def test_evolution_ledger_closes():
    start = physics.terrain(17, 1, relief=2.0)
    z, ledger = physics.evolve(start, 5.0, 2.0, 0.1, 0.02, 0.05)
    assert [r["dt"] for r in ledger] == [2.0, 2.0, 1.0] and physics.closes(ledger) and np.isfinite(z).all()
    edge = hydro.border(z.shape)
    assert np.array_equal(z[edge], start[edge])
    closed, ledger = physics.evolve(start, 4.0, 2.0, 0.1, 0.0, 0.05, base=None)
    assert closed.mean() == pytest.approx(start.mean() + 0.4) and physics.closes(ledger)
    with pytest.raises(ValueError):
        physics.evolve(start, 5.0, 6.0, 0.1, 0.02, 0.05)


def test_a_step_by_hand():
    """A pit: incision follows the filled surface, diffusion the surface itself, both as at the start."""
    z = np.array([[5.0, 5, 5, 5], [5, 1, 4, 5], [5, 5, 3, 2], [5, 5, 5, 5]])
    fill = hydro.filled(z)
    after, _ = physics.evolve(z, 0.5, 0.5, 0.2, 0.3, 0.1, m=0.5, n=2.0)
    to, up = hydro.receivers(fill), hydro.route(z)["upstream"]
    for r, c in ((1, 1), (1, 2), (2, 1), (2, 2)):
        i, j = divmod(int(to[r, c]), 4)
        drop = fill[r, c] - fill[i, j]
        cut = min(0.3 * up[r, c] ** 0.5 * (drop / math.hypot(r - i, c - j)) ** 2 * 0.5, drop)
        lap = z[r - 1, c] + z[r + 1, c] + z[r, c - 1] + z[r, c + 1] - 4 * z[r, c]
        assert after[r, c] == pytest.approx(z[r, c] + 0.1 - cut + 0.1 * lap * 0.5)


@pytest.mark.parametrize(("years", "dt", "want"), [(1000, 400, [400, 400, 200]), (1200, 400, [400] * 3), (0.3, 0.1, [0.1] * 3), (0, 5, []), (1, 5, [1])])
def test_steps_add_up(years, dt, want):
    assert physics.steps(years, dt) == want


def plain_fill(z, seeds, lift):
    """The textbook flood: always the lowest cell reached so far, one at a time."""
    out, done = z.astype(float).copy(), seeds.copy()
    open_ = sorted((out[i, j], i, j) for i, j in zip(*np.nonzero(seeds), strict=True))
    while open_:
        level, i, j = open_.pop(0)
        for a, b in hydro.NEIGHBOURS:
            r, c = i + a, j + b
            if 0 <= r < z.shape[0] and 0 <= c < z.shape[1] and not done[r, c]:
                done[r, c] = True
                out[r, c] = max(out[r, c], level + lift) if out[r, c] <= level else out[r, c]
                open_ = sorted([*open_, (out[r, c], r, c)])
    return out


@pytest.mark.parametrize("kind", ["edges", "holes", "lowest"])
def test_fronts_equal_the_flood(kind):
    rng = np.random.default_rng(6)
    for k in range(12):
        z = np.round(rng.normal(size=(9, 11)).cumsum(k % 2), 1)
        seeds = hydro.lowest_edge(z) if kind == "lowest" else hydro.border(z.shape)
        if kind == "holes":
            seeds[4:6, 3:6] = True
            z[4:6, 3:6] = -1000
        assert np.array_equal(hydro.filled(z, 1e-6, seeds), plain_fill(z, seeds, 1e-6))


def test_holes_take_water():
    """Cells without a height lie below all others, are outlets, and go with the edges policy alone."""
    z = np.add.outer(np.abs(np.arange(20.0) - 10), np.abs(np.arange(20.0) - 10))
    holes = np.zeros(z.shape, bool)
    holes[9:12, 9:12] = True
    z[holes] = np.nan
    r = hydro.route(z, holes=holes)
    into = np.isin(r["receiver"], np.nonzero(holes.ravel())[0])
    assert into.sum() == 16 and np.isfinite(r["fill"]).all() and (r["fill"][holes] == z[~holes].min() - 1000).all()
    assert r["upstream"][holes].sum() == z.size - r["upstream"][(r["receiver"] < 0) & ~holes].sum()
    for policy in ("lowest-edge", "nowhere"):
        with pytest.raises(ValueError):
            hydro.route(z, policy=policy, holes=holes)


def test_standing_chains():
    assert inference._rhat(np.ones((3, 8))) == 1 and inference._rhat(np.repeat([[1.0], [2.0]], 8, 1)) == float("inf")


def test_diagnostics():
    rng = np.random.default_rng(0)
    good = rng.normal(size=(4, 500))
    assert inference.rhat(good) < 1.02 and 1200 < inference.ess_bulk(good) < 2600 and inference.ess_tail(good) > 800
    bad = good + np.arange(4)[:, None]
    assert inference.rhat(bad) > 1.3
    assert inference.average_ranks(np.array([2.0, 1.0, 2.0])).tolist() == [2.5, 1.0, 2.5]


def test_likelihood_equals_dense():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(6, 6))
    cov, r = a @ a.T + np.eye(6), rng.normal(size=6)
    want = -0.5 * r @ np.linalg.inv(cov) @ r - 0.5 * np.log(np.linalg.det(cov)) - 3 * np.log(2 * np.pi)
    assert inference.log_likelihood(r, cov) == pytest.approx(want)


def test_bootstrap_covers():
    mid, low, high = inference.bootstrap_ratio(np.log([0.8, 0.85, 0.9, 0.75]), 2000)
    assert low < mid < high < 1


def test_grouped_likelihood_is_that_of_single_residuals():
    rng = np.random.default_rng(4)
    x = rng.integers(1, 9, 60)
    res = rng.normal(0, 20, 60) + 3 * x
    kernel = lambda a: 400.0 * np.exp(-np.abs(a[:, None] - a[None, :]) / 5.0)
    g, at, n = np.unique(x, return_inverse=True, return_counts=True)
    mean = np.bincount(at, res) / n
    m2 = np.bincount(at, (res - mean[at]) ** 2)
    want = inference.log_likelihood(res, kernel(x) + 100.0 * np.eye(60))
    assert np.isclose(inference.grouped_log_likelihood(mean, n, m2, kernel(g), 100.0), want, rtol=1e-10)


def test_grid_posterior_uses_all_parts(spark, duck, data):
    x, y = (np.array(c, float) for c in zip(*duck.execute("SELECT p_size, p_retailprice FROM part").fetchall(), strict=True))
    cov = 400.0 * np.exp(-np.abs(x[:, None] - x[None, :]) / 5.0) + 100.0 * np.eye(len(x))
    ll = np.array([[inference.log_likelihood(y - (900 + 5 * i) - 0.5 * (j - 7) * x, cov) for j in range(15)] for i in range(15)])
    w = np.exp(ll - ll.max())
    got = {r.i: r.p for r in QUERIES["grid_posterior"](spark, data).collect()}
    assert np.allclose([got[i] for i in range(15)], w.sum(1) / w.sum(), atol=2e-8)


def test_landscape_step_evolves_whole_fields(spark, duck, data):
    got = {(r.region, r.step): r for r in QUERIES["landscape_step"](spark, data).collect()}
    fields = {}
    for k, v in duck.execute("SELECT vec_id, embedding[1:64] FROM embeddings ORDER BY vec_id").fetchall():
        fields.setdefault(k // 64, []).append(v)
    fields = {k: np.array(v, float) for k, v in fields.items() if len(v) == 64}
    assert {k for k, _ in got} == set(fields)
    for k in (0, 3):
        for i, r in enumerate(physics.evolve(fields[k], 5.0, 2.0, 0.05, 0.02, 0.05)[1]):
            own = got[k, i]
            assert own.closed and np.allclose([own.uplift, own.cut, own.moved, own.change], [r[c] for c in ("uplift", "cut", "moved", "change")], atol=1e-6)
            assert np.isclose(own.uplift, 62 * 62 * 0.05 * r["dt"])


@pytest.mark.parametrize("wide", [1, 256])
def test_sweeps_do_not_change_fills(wide, monkeypatch):
    """Sweeps and fronts end at the same levels, with plateaus and with seeds inside."""
    monkeypatch.setattr(hydro, "WIDE", wide)
    rng = np.random.default_rng(4)
    for z in (rng.normal(size=(65, 65)), rng.integers(0, 4, (40, 33)).astype(float), np.zeros((9, 9))):
        seeds = rng.random(z.shape) < 0.01
        seeds[0, 0] = True
        for lift in (0.0, 1e-6):
            f = hydro.filled(z, lift, seeds)
            p = np.pad(f, 1, constant_values=np.inf)
            least = np.min([p[1 + a : 1 + a + z.shape[0], 1 + b : 1 + b + z.shape[1]] for a, b in hydro.NEIGHBOURS], 0)
            assert np.array_equal(f[seeds], z[seeds]) and np.array_equal(f[~seeds], np.where(z > least, z, least + lift)[~seeds])
