"""The inner loops of lm_score in the executors' JVM.

The source below is compiled on the driver by Janino, which comes with Spark, and goes to the executors
as a jar of a few kilobytes.  What it needs to know travels as one broadcast of plain arrays.  Counts are held
outside the heap.  ``lm_score.Decisions`` and ``lm_score.Mixer`` say the same in numpy; tests hold
one to the other.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SOURCE = r"""
package oplake.mixing;

import java.io.Serializable;
import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.Iterator;
import org.apache.spark.TaskContext;
import org.apache.spark.api.java.JavaSparkContext;
import org.apache.spark.api.java.function.MapPartitionsFunction;
import org.apache.spark.broadcast.Broadcast;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;
import org.apache.spark.unsafe.Platform;
import org.apache.spark.util.TaskCompletionListener;

/** What Python calls. */
public class Engine {
    private Broadcast shared;
    private final String key = java.util.UUID.randomUUID().toString();

    public Engine() {}

    /** path: of a file with the number of arrays, then each one's size and bytes, all numbers little-endian. */
    public void load(JavaSparkContext sc, String path) throws Exception {
        java.io.RandomAccessFile in = new java.io.RandomAccessFile(path, "r");
        byte[] eight = new byte[8];
        in.readFully(eight);
        byte[][] parts = new byte[(int) Model.longs(eight)[0]][];
        for (int i = 0; i < parts.length; i++) {
            in.readFully(eight);
            parts[i] = new byte[(int) Model.longs(eight)[0]];
            in.readFully(parts[i]);
        }
        in.close();
        shared = sc.broadcast(parts);
    }

    public MapPartitionsFunction learner() { return new Learner(shared, key); }

    public MapPartitionsFunction scorer() { return new Scorer(shared, key); }

    public void done() { shared.unpersist(); }
}

/** The broadcast's arrays; one for each executor and broadcast. */
class Model {
    /** Steps of a logit's unit in likely. */
    static final float FINE = 512;
    static String lastKey = "";
    static java.lang.ref.SoftReference last = new java.lang.ref.SoftReference(null);

    int bits, wordNodes, firstByte, classes, head, gates, learn, curve, block;
    long firstStride, lastStride;
    double rate, renew;
    float bias, limit, scale, fade, prior;
    int[] length, offset, steps;
    float[] logit, classLogit, cost, weights;
    double[] classPrior, firstWeights, logHead, logKnown;
    float[] likely;   // of bit 1 by its logit, FINE steps a unit from -limit on
    short[] packed;
    int few;
    short[][] ready;
    Index find, known;

    static ByteBuffer of(byte[] b) { return ByteBuffer.wrap(b).order(ByteOrder.LITTLE_ENDIAN); }
    static long[] longs(byte[] b) { long[] x = new long[b.length / 8]; of(b).asLongBuffer().get(x); return x; }
    static int[] ints(byte[] b) { int[] x = new int[b.length / 4]; of(b).asIntBuffer().get(x); return x; }
    static short[] shorts(byte[] b) { short[] x = new short[b.length / 2]; of(b).asShortBuffer().get(x); return x; }
    static float[] floats(byte[] b) { float[] x = new float[b.length / 4]; of(b).asFloatBuffer().get(x); return x; }
    static double[] doubles(byte[] b) { double[] x = new double[b.length / 8]; of(b).asDoubleBuffer().get(x); return x; }

    static synchronized Model of(Broadcast shared, String key) {
        Model found = (Model) last.get();
        if (found == null || !lastKey.equals(key)) {
            last.clear();
            found = new Model((byte[][]) shared.value());
            last = new java.lang.ref.SoftReference(found);
            lastKey = key;
        }
        return found;
    }

    Model(byte[][] p) {
        long[] n = longs(p[0]);
        bits = (int) n[0]; wordNodes = (int) n[1]; firstByte = (int) n[2]; classes = (int) n[3]; gates = (int) n[4]; learn = (int) n[5];
        curve = (int) n[6]; block = (int) n[7]; firstStride = n[8]; lastStride = n[9]; few = (int) n[10];
        double[] d = doubles(p[1]);
        rate = d[0]; renew = d[1]; bias = (float) d[2]; limit = (float) d[3]; scale = (float) d[4]; fade = (float) d[5]; prior = (float) d[6];
        long[] hash = longs(p[2]);
        head = hash.length;
        find = new Index(hash);
        length = ints(p[3]); offset = ints(p[4]); steps = ints(p[5]); logit = floats(p[6]); classLogit = floats(p[7]); classPrior = doubles(p[8]);
        firstWeights = doubles(p[9]); packed = shorts(p[10]); cost = floats(p[11]);
        likely = new float[(int) (2 * limit * FINE) + 1];
        for (int i = 0; i < likely.length; i++) likely[i] = (float) (1 / (1 + Math.exp(limit - i / (double) FINE)));
        if (p.length > 12) {
            ready = new short[][] {shorts(p[12]), shorts(p[13]), shorts(p[14])};
            logHead = doubles(p[15]);
            known = new Index(longs(p[16]));
            logKnown = doubles(p[17]);
            weights = new float[gates * 6];
            for (int i = 0; i < weights.length; i++) weights[i] = (float) firstWeights[i];
        }
    }
}

/** Places of hashes. */
class Index {
    final long[] keys;
    final int[] place;
    final int shift;
    int zero = -1;

    Index(long[] all) {
        int b = 4;
        while ((1L << b) < 2L * all.length) b++;
        keys = new long[1 << b];
        place = new int[1 << b];
        shift = 64 - b;
        for (int i = 0; i < all.length; i++) {
            if (all[i] == 0) { zero = i; continue; }
            int at = (int) (all[i] >>> shift);
            while (keys[at] != 0) at = at + 1 & keys.length - 1;
            keys[at] = all[i];
            place[at] = i;
        }
    }

    int get(long h) {
        if (h == 0) return zero;
        int at = (int) (h >>> shift);
        while (keys[at] != 0) {
            if (keys[at] == h) return place[at];
            at = at + 1 & keys.length - 1;
        }
        return -1;
    }
}

/** The tokens and decisions of one text. */
class Decisions {
    static final long BASE = 0x9E3779B97F4A7C15L, K1 = 0x9E3779B97F4A7C15L, K2 = 0xD6E8FEB86659FD93L, K3 = 0xC2B2AE3D27D4EB4FL;
    static final int M1 = 0x85EBCA6B, M2 = 0x9E3779B1, FOLLOW = 257;

    final Model m;
    int tokens, n;
    long[] hash = new long[64];           // of each word; 1 for the end
    int[] unit = new int[64], start = new int[65];
    int[] step = new int[256], a = new int[256], b = new int[256], c = new int[256];   // a, b, c: the slots
    short[] x = new short[0], y = new short[0], z = new short[0];                      // what they hold
    byte[] match = new byte[256];         // 0, or +-1 by the bit foretold, +-2 at a token's first decision
    private long[] pair = new long[16];   // hashes of two words, and the last token that came after them
    private int[] seen = new int[16];
    private final double[] like;
    private final short[] readA, readB, readC;

    Decisions(Model m, short[][] ready) {
        this.m = m;
        like = new double[m.classes];
        readA = ready[0]; readB = ready[1]; readC = ready[2];
    }

    static long mixed(long x) {
        x = (x ^ x >>> 33) * 0xFF51AFD7ED558CCDL;
        x = (x ^ x >>> 33) * 0xC4CEB9FE1A85EC53L;
        return x ^ x >>> 33;
    }

    static int lower(byte x) { int v = x & 255; return v >= 65 && v <= 90 ? v + 32 : v; }

    private void path(int u, long c1, long c2, long c3) {
        int len = m.length[u], from = m.offset[u], shift = 32 - m.bits;
        if (n + len > step.length) {
            int to = Math.max(n + len, (int) Math.min(2L * step.length, Integer.MAX_VALUE - 16));
            step = java.util.Arrays.copyOf(step, to);
            a = java.util.Arrays.copyOf(a, to);
            b = java.util.Arrays.copyOf(b, to);
            c = java.util.Arrays.copyOf(c, to);
            match = java.util.Arrays.copyOf(match, to);
        }
        fill(len, from, shift, (int) (c1 >>> 32) * M2, (int) (c2 >>> 32) * M2, (int) (c3 >>> 32) * M2);
        n += len;
    }

    private void fill(int len, int from, int shift, int h1, int h2, int h3) {
        int[] steps = m.steps, step = this.step, a = this.a, b = this.b, c = this.c;
        for (int j = 0, at = n; j < len; j++, at++) {
            int s = steps[from + j], node = (s >> 1) * (M1 * M2);
            step[at] = s;
            a[at] = h1 + node >>> shift;
            b[at] = h2 + node >>> shift;
            c[at] = h3 + node >>> shift;
        }
    }

    /** Reads do not wait for what is done with them, so many are under way at once. */
    private static void gather(short[] from, int[] at, short[] to, int n) {
        for (int i = 0; i < n; i++) to[i] = from[at[i]];
    }

    private void gather() {
        gather(readA, a, x, n);
        gather(readB, b, y, n);
        gather(readC, c, z, n);
    }

    void read(byte[] text) {
        tokens = n = 0;
        int size = text == null ? 0 : text.length, at = 0;
        long one = 0, two = 0;
        System.arraycopy(m.classPrior, 0, like, 0, like.length);
        int room = 16;
        while (room < size) room <<= 1;   // at most size / 2 + 1 tokens
        if (pair.length < room) { pair = new long[room]; seen = new int[room]; }
        else java.util.Arrays.fill(seen, 0, room, 0);
        while (true) {
            while (at < size && (text[at] == 32 || text[at] >= 9 && text[at] <= 13)) at++;
            int from = at;
            long h = 0, power = 1;
            while (at < size && text[at] != 32 && (text[at] < 9 || text[at] > 13)) {
                h += (lower(text[at]) + 1) * power;
                power *= BASE;
                at++;
            }
            boolean end = at == from;
            h = end ? 1 : mixed(h + (at - from));
            if (tokens + 1 >= unit.length) {
                hash = java.util.Arrays.copyOf(hash, 2 * tokens + 2);
                unit = java.util.Arrays.copyOf(unit, 2 * tokens + 2);
                start = java.util.Arrays.copyOf(start, 2 * tokens + 3);
            }
            int u = end ? m.head + 1 : m.find.get(h);
            boolean spelled = u < 0;
            if (spelled) u = m.head;
            hash[tokens] = h;
            unit[tokens] = u;
            start[tokens] = n;
            int kind = 0;
            for (int k = 1; k < like.length; k++) if (like[k] > like[kind]) kind = k;
            path(u, one * K1, (one * K2 + two) * K3, (kind + 7L) * K2);
            if (spelled) {
                long p0 = 0, p1 = 0, p2 = 0, p3 = 0;
                int last = FOLLOW - 1;
                for (int i = from; i <= at; i++) {
                    int x = i < at ? lower(text[i]) : 256;
                    long low = p0 * 512 + p1;
                    path(m.firstByte + last * FOLLOW + x, (low + (1L << 40)) * K1, ((p2 * 512 + p3) * (1L << 18) + low + (1L << 50)) * K3, ((p2 * (1L << 18) + low) * 16 + kind + (1L << 60)) * K2);
                    p3 = p2; p2 = p1; p1 = p0; p0 = x + 1;
                    last = x;
                }
            }
            start[tokens + 1] = n;
            java.util.Arrays.fill(match, start[tokens], n, (byte) 0);
            if (one != 0) {
                long key = (one * K2 + two) * K3;
                int place = (int) (mixed(key) >>> 33) & room - 1;
                while (seen[place] != 0 && pair[place] != key) place = place + 1 & room - 1;
                if (seen[place] != 0) foretell(seen[place] - 1, tokens);
                pair[place] = key;
                seen[place] = tokens + 1;
            }
            if (u < m.head && like.length > 1) {
                int row = u * like.length;
                for (int k = 0; k < like.length; k++) like[k] += m.classLogit[row + k];
            }
            tokens++;
            if (end) break;
            two = one;
            one = h;
        }
        if (x.length < n) { x = new short[step.length]; y = new short[step.length]; z = new short[step.length]; }
        gather();
    }

    /** What the token before took, while it agrees. */
    private void foretell(int before, int token) {
        int size = 2;
        for (int s = start[token], p = start[before]; s < start[token + 1] && p < start[before + 1]; s++, p++) {
            match[s] = (byte) ((step[p] & 1) == 1 ? size : -size);
            size = 1;
            if (((step[s] ^ step[p]) & 1) == 1) return;
        }
    }
}

class Learner implements MapPartitionsFunction, Serializable {
    private static final long serialVersionUID = 1L;
    private final Broadcast shared;
    private final String key;

    Learner(Broadcast shared, String key) { this.shared = shared; this.key = key; }

    public Iterator call(Iterator rows) {
        Counts own = new Counts(Model.of(shared, key));
        TaskContext task = TaskContext.get();
        if (task != null) task.addTaskCompletionListener(own);
        while (rows.hasNext()) {
            Row r = (Row) rows.next();
            own.learn(r.isNullAt(0) ? null : (byte[]) r.get(0));
        }
        own.finish();
        return own;
    }
}

/** A task's tables; gives them out in blocks. */
class Counts implements Iterator, TaskCompletionListener {
    final Model m;
    final Decisions d;
    final int slots;
    final double[] weights, used, up, down;
    final float[] w;
    private long counts;   // address: of each table two ints a slot
    private final short[][] ready;
    private long since, blocks, learned;
    private int inBlock, given = -1;
    private final long task = java.util.UUID.randomUUID().hashCode() & 0xFFFFFFFFL;

    Counts(Model m) {
        this.m = m;
        slots = 1 << m.bits;
        ready = new short[3][slots];
        d = new Decisions(m, ready);
        weights = (double[]) m.firstWeights.clone();
        used = new double[m.gates];
        up = new double[m.gates * 6];
        down = new double[m.gates * 6];
        w = new float[m.gates * 6];
        counts = Platform.allocateMemory(24L * slots);
        Platform.setMemory(counts, (byte) 0, 24L * slots);
        for (int i = 0; i < w.length; i++) w[i] = (float) weights[i];
    }

    public void onTaskCompletion(TaskContext context) { free(); }

    private void free() {
        if (counts != 0) Platform.freeMemory(counts);
        counts = 0;
    }

    void learn(byte[] text) {
        d.read(text);
        int n = d.n;
        for (int at = 0; at < n; ) {
            int end = (int) Math.min((long) n, (long) at + m.learn - inBlock);
            run(at, end);
            inBlock += end - at;
            at = end;
            if (inBlock == m.learn) correct();
        }
        count(d.a, counts);
        count(d.b, counts + 8L * slots);
        count(d.c, counts + 16L * slots);
        learned += n;
        since += n;
        if (since >= m.renew * slots) renew();
    }

    private void count(int[] slot, long table) {
        int[] step = d.step;
        for (int i = 0, n = d.n; i < n; i++) {
            long at = table + 8 * (slot[i] & 0xFFFFFFFFL) + 4 * (step[i] & 1);
            Platform.putInt(null, at, Platform.getInt(null, at) + 1);
        }
    }

    private void run(int from, int end) {
        int[] step = d.step;
        short[] xs = d.x, ys = d.y, zs = d.z;
        byte[] match = d.match;
        float[] logit = m.logit, likely = m.likely, w = this.w;
        double[] up = this.up, down = this.down, used = this.used;
        float bias = m.bias, limit = m.limit, curve = m.curve;
        int wordNodes = m.wordNodes, every = m.curve, next = from + (int) ((blocks % every - inBlock % every + every) % every);
        for (int i = from; i < end; i++) {
            int s = step[i], node = s >> 1, bit = s & 1, f = match[i], va = xs[i], vb = ys[i], vc = zs[i];
            int gate = 3 * (((((node >= wordNodes ? 4 : 0) + (va & 3)) * 4 + (vb & 3)) * 4 + (vc & 3))) + (f < 0 ? -f : f), g = gate * 6;
            float x0 = logit[node], x1 = (va >> 2) * (1 / 256f), x2 = (vb >> 2) * (1 / 256f), x3 = (vc >> 2) * (1 / 256f);
            float z = w[g + 5] * bias + w[g] * x0 + (w[g + 1] * x1 + w[g + 2] * x2) + w[g + 3] * x3, x4 = 0f;
            if (f != 0) { x4 = f > 0 ? 1f : -1f; z += w[g + 4] * x4; }
            z = z < -limit ? -limit : z > limit ? limit : z;
            float p = likely[(int) ((z + limit) * Model.FINE + 0.5f)], wrong = bit - p;
            up[g] += wrong * x0;
            up[g + 1] += wrong * x1;
            up[g + 2] += wrong * x2;
            up[g + 3] += wrong * x3;
            if (f != 0) up[g + 4] += wrong * x4;
            up[g + 5] += wrong * bias;
            used[gate]++;
            if (i == next) {
                float h = p * (1 - p) * curve;
                down[g] += x0 * x0 * h;
                down[g + 1] += x1 * x1 * h;
                down[g + 2] += x2 * x2 * h;
                down[g + 3] += x3 * x3 * h;
                down[g + 4] += x4 * x4 * h;
                down[g + 5] += bias * bias * h;
                next += every;
            }
        }
    }

    /** Corrects the weights by what was learned since the last time. */
    private void correct() {
        for (int i = 0; i < w.length; i++) {
            weights[i] += m.rate * up[i] / (3.0 * down[i] + 20.0);
            w[i] = (float) weights[i];
            up[i] = down[i] = 0;
        }
        blocks++;
        inBlock = 0;
    }

    void finish() { if (inBlock > 0) correct(); }

    /** Takes the counts into what predictions read. */
    private void renew() {
        for (int k = 0; k < 3; k++) renew(ready[k], counts + 8L * k * slots);
        since = 0;
    }

    private void renew(short[] ready, long table) {
        short[] packed = m.packed;
        int few = m.few;
        for (int i = 0; i < ready.length; i++) {
            int none = Platform.getInt(null, table + 8L * i), one = Platform.getInt(null, table + 8L * i + 4);
            if (((none | one) & -few) == 0) ready[i] = packed[none * few + one];   // few is a power of 2
            else ready[i] = (short) ((int) Math.rint((Math.log((one & 0xFFFFFFFFL) + 0.4) - Math.log((none & 0xFFFFFFFFL) + 0.4)) * 256) << 2 | 3);
        }
    }

    public boolean hasNext() {
        boolean more = learned > 0 && given < 3 * (slots / m.block);
        if (!more) free();
        return more;
    }

    public Object next() {
        byte[] out;
        if (given < 0) {
            ByteBuffer all = Model.of(new byte[m.gates * 7 * 8]);
            for (int g = 0; g < m.gates; g++) {
                all.putDouble(used[g]);
                for (int k = 0; k < 6; k++) all.putDouble(weights[6 * g + k] * used[g]);
            }
            out = all.array();
        } else {
            int size = 2 * m.block;
            long from = counts + 4L * size * given, most = 0;
            for (int i = 0; i < size; i++) most = Math.max(most, Platform.getInt(null, from + 4L * i) & 0xFFFFFFFFL);
            int width = most < 256 ? 1 : most < 65536 ? 2 : 4;
            ByteBuffer all = Model.of(new byte[1 + width * size]);
            all.put((byte) width);
            for (int i = 0; i < size; i++) {
                int v = Platform.getInt(null, from + 4L * i);
                if (width == 1) all.put((byte) v); else if (width == 2) all.putShort((short) v); else all.putInt(v);
            }
            out = all.array();
        }
        byte[] pressed = com.github.luben.zstd.Zstd.compress(out, 1);
        byte[] v = Model.of(new byte[8 + pressed.length]).putLong((long) out.length).put(pressed).array();
        return RowFactory.create(new Object[] {Integer.valueOf(given++), Long.valueOf(task), v});
    }

    public void remove() { throw new UnsupportedOperationException(); }
}

class Scorer implements MapPartitionsFunction, Serializable {
    private static final long serialVersionUID = 1L;
    private final Broadcast shared;
    private final String key;

    Scorer(Broadcast shared, String key) { this.shared = shared; this.key = key; }

    public Iterator call(Iterator rows) { return new Scores(Model.of(shared, key), rows); }
}

/** A row of each text (h null), then rows of its words that are not known here, under one uid. */
class Scores implements Iterator {
    final Model m;
    final Decisions d;
    final Iterator rows;
    private long uid = java.util.UUID.randomUUID().getLeastSignificantBits() & 0x3FFFFFFFFFFFFFFFL;
    private long[] rare = new long[16];
    private int left;

    Scores(Model m, Iterator rows) { this.m = m; this.rows = rows; d = new Decisions(m, m.ready); }

    public boolean hasNext() { return left > 0 || rows.hasNext(); }

    public Object next() {
        if (left > 0) return RowFactory.create(new Object[] {Long.valueOf(uid), Long.valueOf(rare[--left]), null, null, null, null, null, null});
        Row r = (Row) rows.next();
        byte[] text = r.isNullAt(1) ? null : (byte[]) r.get(1);
        d.read(text);
        uid++;
        double part = 0;
        long known = 0;
        for (int t = 0; t < d.tokens - 1; t++) {
            int u = d.unit[t], at;
            if (u < m.head) { part += m.logHead[u]; known++; }
            else if ((at = m.known.get(d.hash[t])) >= 0) { part += m.logKnown[at]; known++; }
            else {
                if (left == rare.length) rare = java.util.Arrays.copyOf(rare, 2 * left);
                rare[left++] = d.hash[t];
            }
        }
        return RowFactory.create(new Object[] {Long.valueOf(uid), null, r.get(0), Long.valueOf(d.tokens), Long.valueOf(known), Double.valueOf(part), Double.valueOf(-nats() / Math.log(10)), Long.valueOf(text == null ? 0 : text.length)});
    }

    /** The cost of the decisions; the weights are corrected after strides of firstStride, four times as many, ... lastStride. */
    private double nats() {
        int[] step = d.step;
        short[] xs = d.x, ys = d.y, zs = d.z;
        byte[] match = d.match;
        float[] logit = m.logit, likely = m.likely, w = m.weights, cost = m.cost, own = new float[6], curve = new float[6];
        float bias = m.bias, limit = m.limit, scale = m.scale;
        int wordNodes = m.wordNodes;
        double total = 0;
        long size = m.firstStride;
        for (int s = 0; s < d.n; size = Math.min(4 * size, m.lastStride)) {
            boolean last = s + size >= d.n;
            int end = last ? d.n : (int) (s + size);
            float o0 = own[0], o1 = own[1], o2 = own[2], o3 = own[3], o4 = own[4], o5 = own[5] * bias;
            float u0 = 0, u1 = 0, u2 = 0, u3 = 0, u4 = 0, u5 = 0, c0 = 0, c1 = 0, c2 = 0, c3 = 0, c4 = 0, c5 = 0;
            for (int i = s; i < end; i++) {
                int t = step[i], node = t >> 1, bit = t & 1, f = match[i], va = xs[i], vb = ys[i], vc = zs[i];
                int g = 6 * (3 * ((((node >= wordNodes ? 4 : 0) + (va & 3)) * 4 + (vb & 3)) * 4 + (vc & 3)) + (f < 0 ? -f : f));
                float x0 = logit[node], x1 = (va >> 2) * (1 / 256f), x2 = (vb >> 2) * (1 / 256f), x3 = (vc >> 2) * (1 / 256f), x4 = f == 0 ? 0f : f > 0 ? 1f : -1f;
                float z = w[g + 5] * bias + w[g] * x0 + (w[g + 1] * x1 + w[g + 2] * x2) + (w[g + 3] * x3 + w[g + 4] * x4);
                z = z < -limit ? -limit : z > limit ? limit : z;
                if (s > 0) {
                    z += (o0 * x0 + o1 * x1) + (o2 * x2 + o3 * x3) + (o4 * x4 + o5);
                    z = z < -limit ? -limit : z > limit ? limit : z;
                }
                total += cost[(int) ((z * (2 * bit - 1) + limit) * scale + 0.5f)];
                if (!last) {
                    float p = likely[(int) ((z + limit) * Model.FINE + 0.5f)], wrong = bit - p, h = p * (1 - p);
                    u0 += wrong * x0; u1 += wrong * x1; u2 += wrong * x2; u3 += wrong * x3; u4 += wrong * x4; u5 += wrong;
                    c0 += x0 * x0 * h; c1 += x1 * x1 * h; c2 += x2 * x2 * h; c3 += x3 * x3 * h; c4 += x4 * x4 * h; c5 += h;
                }
            }
            float[] up = {u0, u1, u2, u3, u4, u5 * bias}, down = {c0, c1, c2, c3, c4, c5 * bias * bias};
            for (int k = 0; k < 6 && !last; k++) {
                curve[k] = m.fade * curve[k] + down[k];
                float v = own[k] + up[k] / (3f * curve[k] + m.prior);
                own[k] = v < -1 ? -1 : v > 1 ? 1 : v;
            }
            s = end;
        }
        return total;
    }

    public void remove() { throw new UnsupportedOperationException(); }
}
"""

_factories: dict[str, object] = {}


def _factory(spark: SparkSession):
    """The driver's class Engine of this application; its jar goes to the executors."""
    sc = spark.sparkContext
    found = _factories.get(sc.applicationId)
    if found is None:
        jvm = sc._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE)
        folder = os.path.realpath(tempfile.mkdtemp(prefix="oplake-jar-"))
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, f"oplake-mixing-{hashlib.sha256(SOURCE.encode()).hexdigest()[:16]}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(path)
        found = _factories[sc.applicationId] = compiler.getClassLoader().loadClass("oplake.mixing.Engine")
    return found


def engine(spark: SparkSession, arrays: list[np.ndarray]):
    """An Engine that has ``arrays`` broadcast; they reach the driver's JVM by a file."""
    made = _factory(spark).newInstance()
    fd, path = tempfile.mkstemp(prefix="oplake-model-")
    try:
        with open(fd, "wb") as f:
            f.write(np.int64(len(arrays)).astype("<i8").tobytes())
            for x in arrays:
                x = np.ascontiguousarray(x, dtype=x.dtype.newbyteorder("<"))
                f.write(np.int64(x.nbytes).astype("<i8").tobytes())
                f.write(x.data if x.nbytes else b"")
        made.load(spark.sparkContext._jsc, os.path.realpath(path))
    finally:
        os.unlink(path)
    return made


def map_rows(df: DataFrame, function, schema: str) -> DataFrame:
    """``df`` through a function of its partitions' rows."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    kind = jvm.org.apache.spark.sql.types.StructType.fromDDL(schema)
    return DataFrame(df._jdf.mapPartitions(function, jvm.org.apache.spark.sql.Encoders.row(kind)), spark)
