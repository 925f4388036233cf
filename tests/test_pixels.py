import numpy as np

from framequorum.functions import pixels as P


def test_measures():
    flat = np.full((10, 12), 120.0)
    assert P.brightness(flat) == 120 and P.laplacian_variance(flat) == 0 and P.exposure(flat) == 0
    assert P.exposure(np.r_[np.full(50, 250.0), np.full(50, 10.0)].reshape(10, 10)) == 1.0
    edge = flat.copy()
    edge[:, 6:] = 200
    assert P.laplacian_variance(edge) > 0


def test_otsu_parts_two_levels():
    g = np.r_[np.full(60, 40.0), np.full(40, 200.0)].reshape(10, 10)
    assert 40 <= P.otsu(g) < 200


def test_skew_is_found_and_undone():
    g = np.full((60, 200), 255.0)
    g[20:26, 20:180] = 0
    g[36:42, 20:180] = 0
    for lean in (-6.0, 4.0):
        assert abs(P.skew(P.rotated(g, lean, 255.0)) + lean) < 1.0
    assert P.skew(g) == 0.0


def test_two_lines_are_split():
    g = np.full((60, 80), 255.0)
    g[8:24, 10:70] = 0
    g[36:52, 10:70] = 0
    row = P.split_row(g)
    assert 24 <= row <= 36 and set(P.prepared(g)) == {"merged", "merged_binary", "line_0", "line_1"}
    assert P.prepared(g[:10, :20]) == {}


def test_homography_and_quads():
    square, quad = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float), np.array([[10, 5], [50, 9], [48, 30], [8, 28]], float)
    assert np.allclose(P.applied(P.homography(square, quad), square), quad)
    assert P.quad_iou(quad, quad) == 1.0 and P.quad_iou(quad, quad + 500) == 0.0
    box = np.array([[0, 0], [9, 0], [9, 9], [0, 9]], float)
    assert P.quad_iou(box, box + [5, 0]) == 50 / 150


def test_only_leaning_quads_are_warped():
    g = np.arange(100 * 100, dtype=float).reshape(100, 100)
    level = np.array([[10, 10], [60, 12], [60, 40], [10, 38]], float)
    assert P.straightened(g, level).shape == (31, 51)
    assert P.straightened(g, np.array([[10, 10], [60, 40], [50, 60], [0, 30]], float)).shape == (22, 58)


def test_padded_size():
    assert P.padded(np.zeros((20, 50))).shape == (48, 320) and P.padded(np.zeros((5, 500))).shape == (48, 320)
    assert P.equalised(np.random.default_rng(1).integers(0, 256, (20, 40)).astype(float)).shape == (20, 40)


def test_skews_are_those_of_single_pictures():
    """Made pictures, two lines that lean, flat and mirrored ones, whose angles tie; and pictures too large for the matrix."""
    i = np.arange(24 * 60)
    made = [(i * (n % 97 + 3) + i // 60 * (n % 31)) % 256 for n in range(0, 3007, 31)]
    lines = np.full((24, 60), 255.0)
    lines[6:9, 5:55] = lines[14:17, 5:55] = 0
    rows = [*(p.reshape(24, 60) for p in made), lines, *(P.rotated(lines, d, 255.0) for d in (-7.3, 3.0, 11.0)), np.full((24, 60), 9.0), np.tile(lines[:, :30], 2)]
    stack = np.array(rows, float)
    assert P.skews(stack).tolist() == [P.skew(g) for g in stack]
    large = np.kron(stack[-6:-4], np.ones((3, 3)))
    assert P.skews(large).tolist() == [P.skew(g) for g in large] and P.skews(stack[:, :3]).tolist() == [0.0] * len(stack)


def test_skews_are_faster_than_one_by_one():
    from time import process_time

    stack = np.random.default_rng(4).integers(0, 256, (150, 24, 60)).astype(float)
    P.skews(stack[:1])
    start = process_time()
    P.skews(stack)
    middle = process_time()
    for g in stack[:50]:
        P.skew(g)
    assert middle - start < 1.5 * (process_time() - middle)
