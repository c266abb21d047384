"""Source texts for the extraction tests."""

GO = r'''package main

import (
	"fmt"
	h "net/http"
)

type Store struct {
	items map[string]int
}

type (
	Key string
	Reader interface {
		Read() error
	}
)

func (s *Store) Get(k string) (int, error) {
	if v, ok := s.items[k]; ok {
		for i := 0; i < v; i++ {
			fmt.Println("x { y", i)
		}
		return v, nil
	}
	switch k {
	case "a":
		return 1, nil
	default:
		return 0, nil
	}
}

func load(url string) {
	http.Get("/api/items")
	req, _ := http.NewRequest("POST", "https://pay.example.com/charge", nil)
	pb.NewUserServiceClient(conn).GetUser(ctx, req)
}
'''

JAVA = r'''package a.b;
import java.util.List;
import static java.util.Map.*;

@RestController
@RequestMapping("/api")
public class Orders<T> extends Base {
    private final RestTemplate restTemplate;
    enum Kind { A, B }
    public Orders(RestTemplate r) { this.restTemplate = r; }

    @GetMapping("/orders/{id}")
    public Order get(@PathVariable String id) {
        if (id == null) { throw new IllegalArgumentException("x"); }
        for (int i = 0; i < 3; i++) { while (true) { break; } }
        return restTemplate.getForObject("/inventory/items", Order.class);
    }

    @RequestMapping(value = "/orders", method = RequestMethod.POST)
    ResponseEntity<List<String>> create(Order o) { return save(o, System.getenv("TOPIC")); }

    void run() {}
    void run(int x) { int y = x > 1 ? 2 : 3; try { run(); } catch (Exception e) { } }
}
interface Shape { double area(); }
'''

RUST = r'''use std::collections::HashMap;
use crate::a::{b, c};

pub struct Point { x: f64 }
enum Kind { A(i32), B }
pub trait Area { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() * 2.0 } }
type Map<'a> = HashMap<&'a str, i32>;

impl<T: Clone> Area for Point {
    fn area(&self) -> f64 { self.x.powi(2) }
}
impl Point {
    pub fn new(x: f64) -> Self { Point { x } }
    async fn walk(&self, n: usize) -> Option<i32> {
        if n > 1 { for i in 0..n { helper::<u8>(i); } } else if n == 1 { loop { break; } }
        match n { 0 => None, _ => Some(Point::new(1.0).area() as i32) }
    }
}
fn helper(i: usize) { println!("{}", i); Vec::new(); }
'''

CPP = r'''#include <vector>
#include "shape.h"
namespace geo {
class Shape : public Base {
public:
    Shape(int n) : n_(n) { init(); }
    virtual double area() const = 0;
    ~Shape() {}
    int size() const { return n_ > 0 ? n_ : 0; }
private:
    int n_;
};
struct Empty;
double Shape::scale(double k) {
    if (k > 1) { for (auto& x : xs_) { use(x); } }
    try { risky(); } catch (...) { return 0; }
    return static_cast<double>(k);
}
int helper(int a);
enum class Color { Red };
}
int helper(int a) { switch (a) { case 1: return geo::f(a); default: return 2; } }
using Id = int;
typedef unsigned long Big;
'''

CSHARP = r'''using System;
using System.Collections.Generic;
namespace App {
    public record Point(int X, int Y);
    public delegate void Handler(object sender);
    public class Service : IService {
        public Service(HttpClient c) { _c = c; }
        public async Task<int> Load(string id) {
            var r = await _c.GetAsync("/api/items");
            if (id == null) { foreach (var x in Items) { Use<int>(x); } }
            switch (id) { case "a": return 1; default: return new Point(1, 2).X; }
        }
        public int Twice(int n) => Add(n, n);
        private static T Make<T>() where T : new() { return new T(); }
    }
    interface IService { int Twice(int n); }
    enum Kind { A }
    struct Pair { }
}
'''

SCRIPT = r'''import { a } from './a';
import type B from "../b";
const x = require('lib');
export type Id = string | { k: number };
export interface Thing { run(): void; }
export const go = async (n: number): Promise<void> => { await work(n); };
const short = n => n + 1;
export abstract class Box<T> extends Base {
  private items: T[] = [];
  constructor(private n: number) { super(); }
  async load<U>(id: string, opts?: { a: number }): Promise<U> {
    if (!id) { return null; } else if (id === 'x') { for (const i of this.items) { use(i ? 1 : 2); } }
    try { go(1); } catch (e) { log(/["'{]/.test(id)); }
    switch (id) { case 'a': return 1; default: return new Set(); }
  }
  get size() { return this.items.length; }
}
function* gen() { yield 1; }
function outer() { function inner() { deep(); } inner(); }
app.get('/users/:id', auth, getUser);
router.post("/items", (req, res) => { save(req); });
fastify.route({ method: ['GET', 'HEAD'], url: '/both', handler: both });
axios.get('/api/users');
fetch(`${process.env.PAY_URL}/charge/${id}`, { method: 'POST' });
const client = make(); client.delete('/things/1');
logger.get('count');
const users = t.router({ getUser: publicProcedure.input(z.string()).query(getUserHandler), make: t.procedure.mutation(async () => 1) });
trpc.user.getUser.useQuery({ id });
const resolvers = { Query: { user: userResolver, list() { return []; } }, Mutation: { addUser: (a) => a } };
const GET_USER = gql`query GetUser($id: ID) { user(id: $id) { name } }`;
useQuery(GET_USER);
apollo.mutate({ mutation: gql`mutation { addUser { id } }` });
producer.send({ topic: 'orders', messages: [] });
sqs.sendMessage({ QueueUrl: 'https://sqs/1/jobs', MessageBody: '' });
sns.publish({ TopicArn: 'arn:aws:sns:eu:1:alerts' });
channel.sendToQueue('mail', buf); nc.publish('subj', d); redis.publish('chan', m);
consumer.subscribe({ topics: ['orders', 'refunds'] }); channel.consume('mail', onMail);
const k = process.env["API_KEY"], m = import.meta.env.MODE;
'''

PYTHON = r'''import os, re
from . import util
from .a.b import c

@app.post("/pay")
async def pay(x):
    if x:
        for y in x:
            z = 1 if y else 2
    elif not x:
        requests.post(os.environ["BASE"] + "/charge", json=x)
    return helper(x)

@bp.route("/both", methods=["GET", "POST"])
def both(): return os.getenv("MODE")

class A:
    def run(self): self.go()
    def run(self, n): httpx.get("/api/x")
'''

ALL = {"go": GO, "java": JAVA, "rust": RUST, "cpp": CPP, "csharp": CSHARP, "typescript": SCRIPT, "python": PYTHON}
