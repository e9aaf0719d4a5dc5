"""Record shapes of the two logs and of the tables derived from them."""

from pyspark.sql import types as T

_s, _l, _d = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# `timestamp` is monotonic nanoseconds in events and epoch seconds in control rows,
# so it is read as text and cast where its unit is known.
KERNEL_RAW = _struct(
    pid=_l, ppid=_l, uid=_l, timestamp=_s, comm=_s, syscall=_s, arg=_s, dest_ip=_s, dest_port=_l,
    marker=_s, backend_pid=_l, attack=_s, _corrupt_record=_s,
)
AUDIT_RAW = _struct(
    session_id=_l, session_start_time=_l, backend_pid=_l, timestamp=_d, event_type=_s, query=_s,
    database=_s, username=_s, client_addr=_s, client_port=_s, marker=_s, attack=_s,
    _corrupt_record=_s,
)
KERNEL_FIELDS = ["pid", "ppid", "uid", "comm", "syscall", "arg", "dest_ip", "dest_port"]
AUDIT_FIELDS = [
    "session_id", "session_start_time", "backend_pid", "event_type", "query", "database",
    "username", "client_addr", "client_port",
]

LABEL_LINE = _struct(session_id=_l, session_start_time=_l, label=_s)
MANIFEST = _struct(
    scenarios=T.MapType(
        _s, _struct(family_id=_s, sessions=T.MapType(_s, _struct(backend_pid=_l)))
    )
)
LIVE_MANIFEST = _struct(
    key=_s, dataset=_s, run=_s, scenario_id=_s, session_label=_s, **{"class": _s}, label=_s,
    role=_s, synthetic_backend_pid=_l, n_statements=_l, psql_exit=_l, started=_d, ended=_d,
    errors=T.ArrayType(_s),
)
SCORE = _struct(
    session_id=_l, risk=_d, rule_score=_d, gat_score=_d, theta_a=_d, scenario=_s, status=_s,
    n_events=_l, behaviors=T.ArrayType(_s), last_event_ts=_d, scored_at=_d,
)
_METRICS = _struct(
    n=_l, n_malicious=_l, tp=_l, fp=_l, fn=_l, tn=_l, precision=_d, recall=_d, f1=_d,
    accuracy=_d, fpr=_d, roc_auc=_d, pr_auc=_d, min_malicious_score=_d, max_benign_score=_d,
    margin=_d,
)
REPORT = _struct(
    fold=_s, test_templates=T.ArrayType(_s), val_templates=T.ArrayType(_s), model=_s, theta=_d,
    unseen=_METRICS, unseen_gat_only=_METRICS, seen_test=_METRICS,
)

_data = T.ArrayType(_struct(_key=_s, _VALUE=_s))
GRAPHML = _struct(
    key=T.ArrayType(_struct(**{"_id": _s, "_for": _s, "_attr.name": _s, "_attr.type": _s})),
    graph=_struct(
        node=T.ArrayType(_struct(_id=_s, data=_data)),
        edge=T.ArrayType(_struct(_source=_s, _target=_s, _id=_s, data=_data)),
    ),
)

_endpoint = _struct(ip=_s, port=_l)
SPEC = _struct(
    scenario_id=_s, family_id=_s, domain=_s, matched_pair_id=_s, time_of_day=_s,
    default_class=_s, rule_engine_relationship=_s,
    matched_dimensions=_struct(fixed=T.ArrayType(_s), varied=T.ArrayType(_s)),
    sessions=T.ArrayType(
        _struct(
            session_label=_s, **{"class": _s}, role=_s, anchor=_s, anchor_query=_s,
            concurrent_with=_s, delay_after_previous_seconds=_d,
            timing=_struct(tempo=_s, step_gaps_seconds=T.ArrayType(_d)),
            events=T.ArrayType(
                _struct(
                    step_id=_s, sql=_s,
                    process=_struct(comm=_s, args=T.ArrayType(_s), parent=_s),
                    file=_struct(path=_s, syscall=_s, parent=_s),
                    connect=_struct(ip=_s, port=_l, parent=_s),
                    connects_to=_endpoint,
                )
            ),
        )
    ),
)
