"""The words that name what a form does, in the languages whose pages are met, without diacritics.

Each text lists its terms between bars, in the order in which they are tried.
"""

from __future__ import annotations


def terms(text: str) -> tuple[str, ...]:
    return tuple(t.strip() for t in text.replace("\n", " ").split("|") if t.strip())


BROADCAST_STRONG = terms("""
    post | publish | tweet | reply | comment | share | invite | message | dm | broadcast | announce | notify | email |
    posten | veroffentlichen | kommentieren | kommentar | antworten | teilen | einladen | nachricht |
    publier | commenter | commentaire | repondre | partager | inviter |
    publicar | comentar | comentario | responder | compartir | invitar | mensaje |
    pubblica | pubblicare | commenta | commentare | rispondi | condividi | invita | messaggio |
    comentario | compartilhar | partilhar | convidar | mensagem |
    게시 | 댓글 | 답글 | 공유 | 초대 | 메시지 | 쪽지 | 投稿 | 返信 | コメント | 共有 | 招待 | メッセージ |
    发布 | 回复 | 评论 | 分享 | 邀请 | 消息 | 發佈 | 發布 | 回覆 | 評論 | 邀請 | 訊息
""")

BROADCAST_SEND = terms("send | send it | senden | absenden | envoyer | enviar | invia | inviare | 전송 | 보내기 | 보내 | 送信 | 发送 | 發送")

DESTRUCTIVE = terms("""
    delete | remove | erase | wipe | purge | destroy | deactivate | revoke | terminate | unsubscribe | cancel | close account |
    delete account | uninstall | discard | shut down |
    loschen | entfernen | kundigen | deaktivieren | widerrufen | abbestellen | sperren |
    supprimer | effacer | retirer | annuler | desactiver | revoquer | resilier | se desinscrire |
    eliminar | borrar | quitar | cancelar | desactivar | revocar | dar de baja |
    elimina | eliminare | cancella | cancellare | rimuovi | rimuovere | disattiva | revoca | annulla |
    excluir | apagar | remover | desativar | revogar |
    삭제 | 제거 | 탈퇴 | 해지 | 취소 | 비활성화 | 철회 | 削除 | 消去 | 解約 | 退会 | 取消 | 取り消し | 無効化 |
    删除 | 移除 | 注销 | 取消 | 停用 | 撤销 | 刪除 | 註銷 | 撤銷
""")

PAYMENT = terms("""
    pay | pay now | pay securely | pay with | make payment | confirm payment | complete payment | submit payment | checkout |
    check out | place order | place your order | confirm order | complete order | submit order | buy | buy now | buy it now |
    purchase | complete purchase | confirm purchase | donate | donation | give now | pledge | add payment | billing |
    charge my card | start subscription | confirm subscription | payment | charge | charges | paypal | checkout session |
    bezahlen | jetzt bezahlen | zur kasse | kostenpflichtig bestellen | kaufen | jetzt kaufen | spenden | zahlungspflichtig bestellen | zahlung |
    payer | payer maintenant | paiement | proceder au paiement | acheter | acheter maintenant | passer la commande | commander et payer | faire un don |
    pagar | pagar ahora | pago | realizar el pedido | finalizar compra | comprar | comprar ahora | donar | donacion |
    paga | paga ora | pagare | pagamento | acquista | acquistare | acquista ora | completa l ordine | dona | donazione |
    finalizar compra | finalizar pedido | comprar agora | doar | doacao |
    결제 | 구매하기 | 주문하기 | 후원 | 기부 | 支払 | 購入 | 決済 | 注文確定 | 寄付 |
    支付 | 付款 | 购买 | 结算 | 结账 | 提交订单 | 捐款 | 捐赠 | 購買 | 結算 | 結帳 | 付費 | 捐贈
""")

PAYMENT_CONFIRM = terms("""
    confirm | confirm and continue | continue | complete | finish | proceed | submit | order | subscribe | upgrade | renew | join |
    bestatigen | weiter | fortfahren | bestellen | abschliessen | confirmer | continuer | terminer | commander |
    confirmar | continuar | finalizar | pedido | suscribirse | conferma | continua | completa | ordine | abbonarsi |
    confirmar | continuar | concluir | assinar | 확인 | 계속 | 완료 | 주문 | 구독 | 確認 | 続ける | 完了 | 注文 | 購読 |
    确认 | 继续 | 完成 | 订单 | 订阅 | 確認 | 繼續 | 完成 | 訂單
""")

PAYMENT_PATHS = terms("""
    pay | payment | payments | checkout | charge | charges | billing | purchase | order | orders | cart | basket | donate |
    donation | subscribe | subscription | stripe | paypal | braintree | adyen | kasse | paiement | pagar | pago | pagamento | 결제 | 決済 | 支付
""")

ASSENT = terms("""
    i agree | i accept | i consent | agree to the terms | accept the terms | terms of service | terms and conditions |
    privacy policy | user agreement | license agreement | licence agreement | eula |
    ich stimme zu | agb | nutzungsbedingungen | datenschutzerklarung | einwilligung |
    j accepte | conditions generales | conditions d utilisation | politique de confidentialite |
    acepto | terminos y condiciones | terminos de servicio | politica de privacidad |
    accetto | termini e condizioni | informativa sulla privacy | aceito | termos e condicoes | termos de servico | politica de privacidade |
    이용약관 | 개인정보처리방침 | 동의합니다 | 利用規約 | プライバシーポリシー | 同意します | 服务条款 | 隐私政策 | 服務條款 | 隱私政策
""")

ASSENT_LABELS = ASSENT + terms("""
    agree | accept | terms | conditions | consent | waiver | zustimmen | akzeptieren | bedingungen | accepter | consentement |
    aceptar | consentimiento | terminos | accettare | consenso | termini | aceitar | termos | 동의 | 약관 | 同意 | 規約 | 条款 | 條款
""")

SEARCH = terms("""
    search | find | lookup | look up | query | browse | suchen | suche | buscar | busqueda | rechercher | recherche |
    cerca | ricerca | pesquisar | zoeken | 검색 | 찾기 | 検索 | 搜索 | 搜尋
""")
