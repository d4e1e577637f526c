"""Complexity from tokens against counts by hand."""

from plumbline.operators import syntax
from plumbline.sources import lexer

SOURCE = '''fn plain() -> i32 { 1 }
async fn waits() {
    let x = async move { 1 };
}
fn branches(a: bool, b: bool) -> i32 {
    if a && b {
        1
    } else if b || a {
        2
    } else {
        while a {
            loop { break; }
        }
        3
    }
}
fn arms(x: Option<i32>) -> Result<i32, ()> {
    let y = match x {
        Some(n) if n > 3 => n,
        Some(n) => {
            for i in 0..n {
                if i > 2 { return Ok(i); }
            }
            n
        }
        None => 0,
    };
    let f = |a: i32| { if a > 1 { a } else { 0 } };
    println!("{} && {}", y, if y > 0 { 1 } else { 2 });
    let v = vec![1, 2];
    let z = call(|| v.len())?;
    // if while for && ||
    let s = "if && match {";
    Ok(z)
}
impl Thing for Other {
    fn one_line(&self) -> bool { self.a && self.b || !self.c }
    fn after(&self) { if self.a { } if self.b { } }
}
'''
# name: cyclomatic, cognitive, deepest nesting
WANT = {
    "plain": (1, 1, 0),
    "waits": (3, 3, 0),
    # if, &&, if (in the first), ||, while, loop: 0, 1, 1, 2, 2, 3 control expressions around them
    "branches": (7, 1 + 1 + 1 + 1 + 2 + 2 + 3, 4),
    # match; three arms (1); for (1); if (2); the closure's if; vec! (0); ? (0)
    "arms": (1 + 1 + 3 + 1 + 1 + 1 + 1 + 1, 1 + 1 + 3 + 1 + 2 + 1 + 1 + 1, 3),
    "one_line": (3, 3, 0),
    "after": (3, 3, 1),
}


def test_complexity_of_functions(spark):
    files = spark.createDataFrame([("src/a.rs", "rust", SOURCE), ("b.py", "python", "def f(x):\n    if x:\n        return 1\n"), ("c.rs", "rust", None)], "path string, language string, text string")
    got = {r.id.rsplit("::", 1)[1]: (r.cyclomatic, r.cognitive, r.nesting_max) for r in syntax.complexity(lexer.lexed(files)).collect()}
    assert got == WANT
    assert syntax.complexity(lexer.lexed(files.limit(0))).count() == 0
