"""Chunks of actions that arrive one after the other, against a plain loop."""

import random

from epistrata.streaming import queues

W = (0.3, 0.7)


def test_queue_after_every_arrival(spark):
    rng, rows, want = random.Random(5), [], {}
    for robot in range(4):
        queue = {}
        for seq in sorted(rng.sample(range(20), 9)):
            latest = None if rng.random() < 0.2 else rng.randrange(0, 12)
            chunk = {t: [rng.random(), rng.random()] for t in rng.sample(range(16), 9)}
            rows += [(robot, seq, latest, t, a) for t, a in chunk.items()]
            queue = {t: [W[0] * x + W[1] * y for x, y in zip(queue[t], a)] if t in queue else a for t, a in chunk.items() if latest is None or t > latest}
            want |= {(robot, seq, t): a for t, a in queue.items()}
    df = spark.createDataFrame(rows, "robot long, seq long, latest long, timestep long, action array<double>")
    got = {(r.robot, r.seq, r.timestep): r.action for r in queues.merge_arrivals(df, W).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-12 for k in want for x, y in zip(got[k], want[k]))
