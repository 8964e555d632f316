"""Meaning of scripts: both sides are evaluated and compared."""

import datetime

import pytest

from qspark.lang import Interpreter, parse
from qspark.lang.reader import Time, Vec


@pytest.fixture(scope="module")
def q(spark):
    return Interpreter(spark)


PLAIN = [
    ("(/ -9 4)", "-3"), ("(/ 8 0)", "null"), ("(/ -7 0.50)", "-14"), ("(/ -8 3.00)", "-3"), ("(% 11 -4)", "-1"), ("(div 9 4)", "2.25"), ("(div 3 0)", "null"), ("(/ 9007199254740993 1)", "9007199254740993"),
    ("(xbar (- (til 8) 3) 4)", "[-4 -4 -4 0 0 0 0 4]"), ("(xbar -9.5 3)", "-12.0"), ("(xbar 2021.03.05 4)", "2021.03.03"), ("(xbar 07:08:09.750 500)", "07:08:09.500"),
    ("(xbar 2023.06.07D01:02:03.000045678 1000)", "2023.06.07D01:02:03.000045000"), ("(xbar 2023.06.07D01:02:03.456000000 00:00:00.100)", "2023.06.07D01:02:03.400000000"),
    ("(sum [5 0Nl 7])", "12"), ("(avg [3 0Nl 8 10])", "7.0"), ("(avg [0Nl 0Nl])", "null"), ("(dev [4 0Nl 10])", "3.0"), ("(sum [])", "0"), ("(min [])", "null"), ("(med [])", "null"), ("(med [9 2 4 7])", "5.5"),
    ("(rank [8 5 9 1])", "[2 1 3 0]"), ("(xrank [8 5 9 1] 2)", "[1 0 1 0]"), ("(bin [1 5 9] [0 1 6 12])", "[-1 0 1 2]"), ("(binr [1 5 9] [1 4 12])", "[0 1 3]"),
    ('(split ";" ";")', '(list "" "")'), ("(split [7 8 9 10] [0 1 3])", "(list [7] [8 9] [10])"), ("(union [4 5] [5 6])", "[4 5 6]"), ("(sect [7 8 9] [9 7])", "[7 9]"), ("(except [6 6 7 8] [8])", "[6 6 7]"),
    ("(map-left - 20 [4 5])", "[16 15]"), ("(map-right - [9 8] 2)", "[7 6]"), ("(asc [6 0Nl -2 11])", "[0Nl -2 6 11]"), ("(desc [4 9 5])", "[9 5 4]"), ("(idesc [2 7 7 3])", "[1 2 3 0]"), ("(iasc [6 0Nl 2])", "[1 2 0]"),
    ("(take [4 5] 5)", "[4 5 4 5 4]"), ("(take [4 5 6] -1)", "[6]"), ("(take [6 7 8 9] [2 2])", "[8 9]"), ("(at [11 12] 1)", "12"), ("(at [11 12] 9)", "null"), ("(find [3 4] 7)", "null"), ("(find ['p 'q] 'q)", "1"), ("(find [3 0Nl] 0Nl)", "1"),
    ("(== 0Nl 0Nl)", "true"), ("(< 0Nl -99)", "true"), ("(and [false true] [true true])", "[false true]"), ("(in 8 [7 8])", "true"), ("(within [3 6 12] [4 11])", "[false true false]"), ('(like "spark" "s*[qr]?")', "true"), ('(like "spark" "[^s]*")', "false"),
    ("((fn [x y] (+ x y)) 2 3)", "5"), ("(fold (fn [x y] (+ x y)) [1 2 3])", "6"), ("(fold-left (fn [x acc] (- acc x)) [1 2 3] 10)", "4"), ("(scan (fn [x y] (+ x y)) [1 2 3])", "[1 3 6]"), ("(map (fn [x] (* x x)) [1 2 3])", "[1 4 9]"),
    ("(do (let a 3) (* a a))", "9"), ("(if (> 1 2) 'a 'b)", "'b"), ("(try (raise \"oops\") (fn [e] e))", '"oops"'), ("(as 'F64 [3i -8i])", "[3.0 -8.0]"), ("(as 'date \"2022-11-30\")", "2022.11.30"), ("(as 'timestamp \"2023-07-08 06:30:00+02:00\")", "2023.07.08D04:30:00.000000000"),
    ("(reverse [1 2 3])", "[3 2 1]"), ("(raze (list [1 2] [3]))", "[1 2 3]"), ("(remove [1 2 3] 1)", "[1 3]"), ("(where [true false true])", "[0 2]"), ("(filter [1 2 3] [true false true])", "[1 3]"), ("(distinct [3 1 3])", "[1 3]"), ("(count [1 0Nl])", "2"),
    ("(format \"% and %\" 1 2)", '"1 and 2"'), ("(type 5)", "'i64"), ("(type [1.0])", "'F64"), ("(+ 2024.01.30 2)", "2024.02.01"), ("(- 2024.02.01 2024.01.30)", "2"), ("(round -2.5)", "-3.0"), ("(first [7 8])", "7"), ("(last [7 8])", "8"), ("(neg [1 -2])", "[-1 2]"),
    ("(alter [1 2 3] + 1 10)", "[1 12 3]"), ("(key {a: 1 b: 2})", "['a 'b]"), ("(value {a: 1 b: 2})", "[1 2]"), ("(de (ser [1 2 3]))", "[1 2 3]"), ("(set fib (fn [x] (if (< x 2) 1 (+ (self (- x 1)) (self (- x 2)))))) (fib 10)", "89"),
]


@pytest.mark.parametrize("left,right", PLAIN)
def test_plain(q, left, right):
    assert q.run(left) == q.run(right)


def test_enum_and_lists(q):
    q.run("(set d ['x 'y 'z])")
    e = q.run("(enum 'd ['z 'x 'z])")
    assert e == ["z", "x", "z"] and (e.domain, e.places) == ("d", [2, 0, 2])
    with pytest.raises(ValueError):
        q.run("(enum 'd ['w])")
    assert isinstance(q.run("(unify (list 1 2))"), Vec) and not isinstance(q.run("(unify (list 1 'a))"), Vec) and not isinstance(q.run("(diverse [1 2])"), Vec)
    assert q.run("(rc d)") == 2 and q.run("(do (set d2 d) (rc d))") == 3


def test_compiled_functions(q):
    q.run("(set t (table [x] (list [3 4])))")
    assert sorted(r[0] for r in rows(q.run('(do (set f (loadfn "" "hypot" 2)) (select {h: (f x x) from: t}))'))) == [pytest.approx(18**0.5), pytest.approx(32**0.5)]
    with pytest.raises(TypeError):
        q.run("(select {h: (f x) from: t})")
    with pytest.raises(Exception, match="no.such.Class"):
        q.run('(loadfn "no.such.Class" "g" 1)')


def test_rows_by_number(q):
    q.run("(set t (table [x] (list [30 40 50])))")
    assert q.run("(at t 1)") == {"x": 40} and [r["x"] for r in q.run("(at t [2 0 9])")] == [50, 30, None]


def test_closed_handle(q, tmp_path):
    q.run(f'(set h (hopen "{tmp_path}/log")) (write h 1) (hclose h)')
    with pytest.raises(ValueError):
        q.run("(write h 2)")


def rows(t):
    return [tuple(r) for r in t.df.collect()]


def table(q):
    q.run("(set t (table [sym price size] (list [a b a c b] [1.0 2.0 3.0 4.0 5.0] [10 20 30 40 50])))")


def test_select(q):
    table(q)
    assert sorted(rows(q.run("(select {s: (sum price) n: (count price) from: t by: sym})"))) == [("a", 4.0, 2), ("b", 7.0, 2), ("c", 4.0, 1)]
    assert sorted(rows(q.run("(select {from: t by: sym})"))) == [("a", 1.0, 10), ("b", 2.0, 20), ("c", 4.0, 40)]
    assert sorted(rows(q.run("(select {p: price from: t by: sym})"))) == [("a", [1.0, 3.0]), ("b", [2.0, 5.0]), ("c", [4.0])]
    assert rows(q.run("(select {m: (- (max price) (min size)) from: t})")) == [(-5.0,)]
    assert sorted(rows(q.run("(select {sym: sym from: t where: (and (> price 1.5) (== sym 'b))})"))) == [("b",), ("b",)]
    assert sorted(rows(q.run("(select {n: (count sym) from: t by: {b: (xbar size 20)}})"))) == [(0, 1), (20, 2), (40, 2)]
    assert rows(q.run("(select {from: t where: (== price 99)})")) == []
    assert rows(q.run("(select {sym: sym from: t take: 2})")) == [("a",), ("b",)]
    assert sorted(rows(q.run("(select {n: (count (distinct size)) from: t by: sym})"))) == [("a", 2), ("b", 2), ("c", 1)]
    assert rows(q.run("(select {x: s from: (select {s: (sum size) from: t by: sym}) where: (> s 50)})")) == [(70,)]
    assert q.run("(at t 'sym)") == ["a", "b", "a", "c", "b"]
    assert q.run("(count t)") == 5


def test_update_insert_upsert(q):
    table(q)
    assert rows(q.run("(update {size: (* size 1.5) from: t where: (== sym 'a)})")) == [("a", 1.0, 15), ("b", 2.0, 20), ("a", 3.0, 45), ("c", 4.0, 40), ("b", 5.0, 50)]
    assert sorted(r[3] for r in rows(q.run("(update {total: (sum size) from: t by: sym})"))) == [40, 40, 40, 70, 70]
    q.run("(update {price: 0.0 from: 't})")
    assert {r[1] for r in rows(q.run("t"))} == {0.0}
    table(q)
    q.run("(insert 't (list 'd 9.0 90))")
    assert q.run("(count t)") == 6
    q.run("(insert 't {sym: 'e size: 1})")
    assert ("e", None, 1) in rows(q.run("t"))
    with pytest.raises(ValueError):
        q.run("(insert 't {nope: 1})")
    q.run("(set k (table [k1 k2 v] (list [1 2] [1 2] [10 20])))")
    assert sorted(rows(q.run("(upsert k 2 (list [1 3] [1 1] [25 30]))"))) == [(1, 1, 25), (2, 2, 20), (3, 1, 30)]


def test_joins(q):
    q.run("(set trades (table [Sym Time Price] (list [x x] [10:00:01 10:00:05] [100 200])))")
    q.run("(set quotes (table [Sym Time Bid] (list [x x x] [10:00:00 10:00:02 10:00:04] [99 100 101])))")
    assert sorted(q.run("(at (asof-join [Sym Time] trades quotes) 'Bid)")) == [99, 101]
    q.run("(set w (map-left + (at trades 'Time) [-2000 2000]))")
    q.run("(set lo (- (at trades 'Time) 2000)) (set hi (+ (at trades 'Time) 2000))")
    assert sorted(q.run("(at (window-join [Sym Time] (list lo hi) trades quotes {m: (min Bid)}) 'm)")) == [99, 100]
    assert sorted(q.run("(at (window-join1 [Sym Time] (list lo hi) trades quotes {m: (min Bid)}) 'm)")) == [99, 101]
    q.run("(set a (table [id x] (list [1 2 3] [10 20 30]))) (set b (table [id x y] (list [2 2 9] [7 8 9] [70 80 90])))")
    assert sorted(rows(q.run("(left-join [id] a b)"))) == [(1, 10, None), (2, 7, 70), (3, 30, None)]
    assert rows(q.run("(inner-join [id] a b)")) == [(2, 7, 70)]


def test_order_and_sets(q):
    table(q)
    assert q.run("(at (xdesc t 'price) 'size)") == [50, 40, 30, 20, 10]
    assert q.run("(at (xasc t ['sym 'price]) 'size)") == [10, 30, 20, 50, 40]
    assert q.run("(key (except t 'price))") == ["sym", "size"]
    assert q.run("(count (concat t t))") == 10
    assert q.run("(count (union t t))") == 5
    assert q.run("(count (take t 12))") == 12
    assert q.run("(at (take t [1 2]) 'size)") == [20, 30]


def test_storage(q, tmp_path):
    table(q)
    q.run(f'(set-splayed "{tmp_path}/s/" t)')
    assert q.run(f'(count (get-splayed "{tmp_path}/s/"))') == 5
    q.run(f'(write-csv "{tmp_path}/c" t)')
    assert q.run(f'(sum (at (read-csv [SYMBOL F64 I64] "{tmp_path}/c") \'size))') == 150
    q.run(f'(set h (hopen "{tmp_path}/j")) (write h "(set z 41)") (write h "(set z (+ z 1))")')
    assert q.run("(read h)") == [2, 2] and q.run("z") == 42
    q.run(f'(set "{tmp_path}/v" [1 2 3])')
    assert q.run(f'(get "{tmp_path}/v")') == [1, 2, 3]


def test_reader():
    assert parse("[1 2 3]") == [Vec([1, 2, 3])]
    assert parse("2024.01.02 10:00:00.500 ;; note") == [datetime.date(2024, 1, 2), Time(36000500)]
    for bad in ("(", ")", "{a 1}"):
        with pytest.raises(SyntaxError):
            parse(bad)


def test_refused(q):
    with pytest.raises(PermissionError):
        q.run('(system "ls")')
    with pytest.raises(PermissionError):
        q.run('(hopen "localhost:5000")')
    with pytest.raises(NameError):
        q.run("(nope 1)")


# Every name that scripts may call.
NAMES = """read-csv write-csv set-splayed get-splayed set-parted get-parted get set load read write hopen hclose ser de table til rand guid meta key value show
select update insert upsert alter modify where filter at == != < > <= >= and or not in within like nil? if take left-join inner-join asof-join window-join window-join1 find bin binr
sum avg min max count med dev first last row group distinct rank xrank iasc idesc asc desc xasc xdesc reverse union sect except concat raze remove
+ - * / div % neg round floor ceil xbar date time timestamp as split format type list enlist dict enum unify diverse map pmap map-left map-right
fold fold-left fold-right scan scan-left scan-right apply quote let do return try raise parse eval resolve loadfn timer timeit env internals args memstat sysinfo gc rc
os-get-var os-set-var system exit print println"""


def test_all_names(q):
    for name in NAMES.split():
        q.lookup(name, {})
