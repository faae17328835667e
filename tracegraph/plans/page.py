"""A page of its own that draws a view, in two dimensions or three, without anything from elsewhere."""

from __future__ import annotations

import json

from ..schema import CALL_KINDS

_STYLE = "body{margin:0;background:#111;color:#ddd;font:13px sans-serif}canvas{display:block}#panel{position:fixed;left:8px;top:8px;background:#000a;padding:8px}#told{position:fixed;right:8px;bottom:8px}"

# Nodes repel each other by cells of a grid, links pull, and all are drawn in order of depth. A drag turns the view (3D) or moves it (2D), a wheel scales it.
_SCRIPT = """
const at=new Map(graph.nodes.map((n,i)=>[n.id,i])),N=graph.nodes.length;
const p=graph.nodes.map((n,i)=>{const a=i*2.4,r=20*Math.sqrt(i+1);return[r*Math.cos(a),r*Math.sin(a),solid?r*Math.sin(a*1.7):0]}),v=p.map(()=>[0,0,0]);
const links=graph.links.map(l=>({a:at.get(l.source),b:at.get(l.target),kind:l.kind})).filter(l=>l.a!==undefined&&l.b!==undefined);
const kinds=[...new Set(links.map(l=>l.kind))],shown=new Set(kinds.filter(k=>calls.includes(k)));
const c=document.querySelector('canvas'),g=c.getContext('2d'),panel=document.getElementById('panel'),told=document.getElementById('told');
let heat=1,zoom=1,turn=[0,0],shift=[0,0],held=null,query='';
for(const k of kinds){const l=document.createElement('label'),b=document.createElement('input');b.type='checkbox';b.checked=shown.has(k);b.onchange=()=>{b.checked?shown.add(k):shown.delete(k);heat=1};l.append(b,' '+k);panel.append(l,document.createElement('br'))}
const find=document.createElement('input');find.placeholder='name';find.oninput=()=>query=find.value;panel.append(find);
function step(){const size=60,cells=new Map(),key=q=>q.map(x=>Math.floor(x/size)).join();
 p.forEach((q,i)=>{const k=key(q);(cells.get(k)||cells.set(k,[]).get(k)).push(i)});
 for(let i=0;i<N;i++){const q=p[i],z=solid?[-1,0,1]:[0];for(const dx of[-1,0,1])for(const dy of[-1,0,1])for(const dz of z)for(const j of(cells.get(key([q[0]+dx*size,q[1]+dy*size,q[2]+dz*size]))||[]).slice(0,40)){if(i===j)continue;const d=q.map((x,k)=>x-p[j][k]),r=d[0]*d[0]+d[1]*d[1]+d[2]*d[2]+1;for(let k=0;k<3;k++)v[i][k]+=300*heat*d[k]/r/Math.sqrt(r)}
  for(let k=0;k<3;k++)v[i][k]-=q[k]*.002*heat}
 for(const l of links){if(!shown.has(l.kind))continue;for(let k=0;k<3;k++){const d=(p[l.b][k]-p[l.a][k])*.01*heat;v[l.a][k]+=d;v[l.b][k]-=d}}
 for(let i=0;i<N;i++)for(let k=0;k<(solid?3:2);k++){v[i][k]*=.85;p[i][k]+=v[i][k]}
 heat*=.995}
function seen(q){let[x,y,z]=q;const[s,t]=[Math.sin(turn[0]),Math.cos(turn[0])],[m,n]=[Math.sin(turn[1]),Math.cos(turn[1])];[x,z]=[x*t-z*s,x*s+z*t];[y,z]=[y*n-z*m,y*m+z*n];const f=zoom*(solid?600/Math.max(60,600+z):1);return[c.width/2+shift[0]+x*f,c.height/2+shift[1]+y*f,z,f]}
function draw(){if(heat>.02)step();c.width=innerWidth;c.height=innerHeight;const s=p.map(seen);g.strokeStyle='#8885';
 g.beginPath();for(const l of links)if(shown.has(l.kind)){g.moveTo(s[l.a][0],s[l.a][1]);g.lineTo(s[l.b][0],s[l.b][1])}g.stroke();
 for(const i of[...s.keys()].sort((a,b)=>s[b][2]-s[a][2])){const n=graph.nodes[i],hit=query&&n.id.includes(query),r=(n.focus||hit?7:4)*Math.min(2,s[i][3]);g.fillStyle=hit?'#fff':n.color||'#999';g.beginPath();g.arc(s[i][0],s[i][1],r,0,7);g.fill();if(n.focus||hit||N<80)g.fillText(n.id,s[i][0]+8,s[i][1])}
 requestAnimationFrame(draw)}
c.onmousedown=e=>held=[e.x,e.y];onmouseup=()=>held=null;
onmousemove=e=>{if(held){const d=[e.x-held[0],e.y-held[1]];held=[e.x,e.y];if(solid){turn[0]+=d[0]*.005;turn[1]+=d[1]*.005}else{shift[0]+=d[0];shift[1]+=d[1]}return}
 let best=-1,near=100;p.forEach((q,i)=>{const[x,y]=seen(q),d=(x-e.x)**2+(y-e.y)**2;if(d<near){near=d;best=i}});const n=graph.nodes[best];told.textContent=n?`${n.id} (${n.kind}) ${n.file}:${n.line} ${n.module||''}`:''};
onwheel=e=>{zoom*=e.deltaY<0?1.1:.9};draw();
"""


def html_page(document: dict, solid: bool = True) -> str:
    """``solid`` draws in three dimensions."""

    def inside(x: object) -> str:
        return json.dumps(x, ensure_ascii=False).replace("</", "<\\/")

    cut = f"{len(document['links'])} of {document['total']} links" if document.get("total", 0) > len(document["links"]) else ""
    return f'<!doctype html><html><meta charset="utf-8"><title>graph {"3D" if solid else "2D"}</title><style>{_STYLE}</style><canvas></canvas><div id="panel">{cut}<br></div><div id="told"></div><script>const graph={inside(document)},solid={inside(solid)},calls={inside(CALL_KINDS)};{_SCRIPT}</script></html>'
