"""A small trace of our own: six rounds of 40 ms on one device, whose numbers are worked out in the tests by hand."""

import json

START, PERIOD, ROUNDS = 5_000_000, 40_000, 6
COPY_IN, COPY_OUT = 3_000_000, 200_000  # bytes

# (offset, duration, name, category, thread, cpu, device, args); the host copies in, runs two kernels and copies out
ROUND = (
    (0, 12_000, "DataLoader.fetch", "data_loader", 8, 1, -1, {}),
    (1_000, 0, "sched_wakeup", "cpu_sched", 8, 0, -1, {"pid": 7}),
    (4_000, 0, "sched_switch", "cpu_sched", 7, 0, -1, {"prev_pid": 8, "next_pid": 7, "prev_state": "R"}),
    (9_000, 0, "sched_switch", "cpu_sched", 7, 0, -1, {"prev_pid": 7, "next_pid": 0, "prev_state": "S"}),
    (14_000, 0, "sched_switch", "cpu_sched", 8, 0, -1, {"prev_pid": 0, "next_pid": 8, "prev_state": "R"}),
    (16_000, 4_000, "copy_in", "npu_memcpy", -1, -1, 0, {"size_bytes": COPY_IN, "kind": "H2D"}),
    (20_200, 600, "launch_kernel", "cuda_npu_api", 7, 0, -1, {}),
    (21_000, 6_000, "Conv", "npu_kernel", -1, -1, 0, {}),
    (27_000, 2_500, "Gelu", "npu_kernel", -1, -1, 0, {}),
    (32_000, 1_000, "copy_out", "npu_memcpy", -1, -1, 0, {"size_bytes": COPY_OUT, "kind": "D2H"}),
)


def events():
    rows = [{"ph": "M", "name": "process_name", "cat": "metadata", "pid": 77, "tid": 77, "ts": START, "args": {"name": "trainer"}}]
    rows += [{"ph": "M", "name": "thread_name", "cat": "metadata", "pid": 77, "tid": t, "ts": START, "args": {"name": f"t{t}"}} for t in (7, 8)]
    for r in range(ROUNDS):
        for off, dur, name, cat, tid, cpu, dev, extra in ROUND:
            args = dict(extra)
            if dev >= 0:
                args.update(device=dev, stream=0)
            if cpu >= 0:
                args.update(cpu=cpu)
            rows.append({"ph": "X", "name": name, "cat": cat, "pid": 77, "tid": tid, "ts": START + r * PERIOD + off, "dur": dur, "args": args})
    return rows


def write(path):
    path.write_text(json.dumps({"traceEvents": [*events(), 7, "x"]}))
